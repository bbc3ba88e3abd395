"""Path search against os.walk and fnmatch; predictions against the rule, run by run."""

import fnmatch
import math
import os
import random

import pytest

from tidemark.operators import dataset, stats


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    rng, folders = random.Random(3), [root]
    for i in range(60):
        folder = rng.choice(folders) / rng.choice([f"d{i}", f"log{i}", ".__hidden" + str(i), "x y"])
        folder.mkdir(exist_ok=True)
        folders.append(folder)
    for i in range(500):
        (rng.choice(folders) / rng.choice([f"f{i}.log", f"{i}.txt", "same.log", f".__{i}"])).write_text("x" * (i % 7))
    return root


def walked(root, pattern):
    """Every path below root that matches, by taking leading names off it."""

    def names(atom, path):  # wildcards stay within a name
        a, p = atom.split("/"), path.split("/")
        return len(a) == len(p) and all(fnmatch.fnmatchcase(y, x) for x, y in zip(a, p))

    out = set()
    for folder, dirs, files in os.walk(root):
        dirs[:] = [d for d in dirs if not d.startswith(".__")]
        for name in [*dirs, *files]:
            path = "/" + os.path.relpath(os.path.join(folder, name), root)
            tests = [path] + [path[i + 1 :] for i, c in enumerate(path) if c == "/"]
            if not name.startswith(".__") and any(names(atom, x) for atom in pattern.split("|") for x in tests):
                out.add(path)
    return out


@pytest.mark.parametrize("pattern", ["*.log", "/*", "/d*/*.txt|same.log", "d*/f*", "/x y/*|/log*/*/*", "[0-4]*.txt", "nothing", "log?", "x y/[!0-9]*"])
def test_search_is_the_walk(spark, tree, pattern):
    found = dataset.find(spark, str(tree), pattern).collect()
    assert {r.path for r in found} == walked(tree, pattern) and len(found) == len({r.path for r in found})
    for r in found[:20]:
        assert r.is_dir == os.path.isdir(f"{tree}{r.path}")
        assert r.is_dir or r.size == os.path.getsize(f"{tree}{r.path}")


def test_search_stops_at_the_first_of_a_folder(spark, tree):
    first = {r.path for r in dataset.find(spark, str(tree), "*.log", first=True).collect()}
    by_folder = {}
    for x in walked(tree, "*.log"):
        by_folder[os.path.dirname(x)] = min(x, by_folder.get(os.path.dirname(x), x))
    assert first == set(by_folder.values())
    assert dataset.find(spark, str(tree), "").count() == 0 and dataset.find(spark, f"{tree}/absent", "*").count() == 0


@pytest.mark.parametrize("drawn", [True, False])
def test_predictions_follow_the_rule(spark, drawn):
    rng = random.Random(6)
    points = [(g, float(rng.randint(1, 40)), rng.randint(1, 9)) for g in "ab" for _ in range(60)] + [("a", 99.0, 1)]
    uppers = [(g, float(u)) for g in "ab" for u in ((5, 12, 40) if g == "a" else (20, 30, 60))]
    tries = [(i, rng.choice("abc"), rng.choice([None, -1.0, 3.0, 12.0, 25.0, 40.0, 77.0]), rng.random()) for i in range(300)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(2)
    buckets = stats.bucket_probabilities(make(points, "g string, v double, s long"), "g", "v", "s", make(uppers, "g string, upper double"))
    out = stats.predicted_tries(make(tries, "i long, g string, tried double, u double"), "g", "tried", buckets, 2.0, 3.0, "u" if drawn else None)
    got = {r.i: r.allocation for r in out.collect()}
    share = {}
    for g in "ab":
        edges = [u for x, u in uppers if x == g]
        weight = dict.fromkeys(edges, 0)
        for x, v, s in points:
            if x == g:
                weight[next((e for e in edges if v <= e), edges[-1])] += s
        share[g] = [(e, w / sum(weight.values())) for e, w in weight.items() if w]
    for i, g, tried, u in tries:
        last = -1 if tried is None else tried
        left = [x for x in share.get(g, []) if x[0] > last]
        if not left:
            want = 2.0 * 3.0 ** (math.floor(math.log(last / 2) / math.log(3) + 1e-12) + 1) if last > 0 else 2.0
        elif drawn:
            total, so_far, want = sum(p for _, p in left), 0, left[-1][0]
            for e, p in left:
                so_far += p
                if so_far / total > u:
                    want = e
                    break
        else:
            want = left[0][0]
        assert got[i] == pytest.approx(want), (g, tried, u)
