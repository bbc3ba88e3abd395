"""Cross-tokenizer alignment through a dictionary of groups.

Two public tokenizers cut the same bytes differently.  Where a token of A and one of B end at the same byte a group ends;
its A ids and B ids are all that matters of it, and the same groups come again and again.  So

1. Texts are encoded in blocks of documents.  A text is cut before every space or line end that follows other
   characters, where neither tokenizer can join tokens (checked on the vocabularies, else texts stay whole), and
   every distinct piece is encoded once a block.  A block keeps its distinct groups, in how many of its documents
   and how often each occurs, and which groups every document has, as numbers.
2. The blocks' groups are interned: one row for each distinct group of the corpus, with its documents.
3. Links are expanded once per distinct group: token pairs whose bytes overlap.
4. A pair's count is its documents.  A pair of one group has that group's; a pair of several groups is sent back to the
   blocks that hold them, by group key, where the documents of their union are counted; documents lie in one block.
5. The numbers of every group (links, links whose count is the highest of their A id, sum of counts) go back to the
   blocks by group key, and each document sums them by how often it has the group.

What is shuffled are distinct groups by block, not tokens and not documents.  No key is hot: a group has at most one row
a block; the join of links with pairs, where one pair may be in many groups, is salted.  A block is bounded
by its characters.

Defined results: texts that are null or empty, or that a tokenizer does not give back byte by byte (``U+2581`` in
them, say), have no tokens: zeros and an empty string; every row is a document of its own, so repeated rows count
and are returned each, as are rows with a null doc_id; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import salted_join, table, written

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a block's documents; a longer document is a block of its own.
BLOCK_CHARS = 2_000_000
#: Fixed value: the pre-token pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r"(?<=\S)(?=[ \n])")
MARK = "▁"

#: Vocabularies of this Python worker.
_loaded: dict[tuple[str, str], Vocabularies] = {}


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and the groups of pieces of text."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken

        self.a_file, a = a_file, json.loads(a_file)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        alphabet, ids, special = byte_alphabet(), a["model"]["vocab"], {x["content"]: x["id"] for x in a["added_tokens"]}
        self.a_bytes = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in ids.items():
            self.a_bytes[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id(MARK)
        before = a["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        joins = any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        #: Whether texts may be cut: A's pattern begins a token at white space after other characters, B joins nothing there.
        self.cuts = plain and not joins
        merged = ("".join(x.split(" ") if isinstance(x, str) else x) for x in a["model"]["merges"])
        # where merges come in the order of ids, ids are ranks, and a faster encoder does the same
        self.quick = None
        if plain and all(ids[x] == 256 + i for i, x in enumerate(merged)):
            ranks = {self.a_bytes[i]: i for token, i in ids.items() if token not in special}
            self.quick = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def a(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_str(self.a_file.decode())
        out.encode_special_tokens = True
        return out

    def pieces(self, text: str) -> list[str]:
        """The pieces of a space and the text."""
        return CUT.split(" " + text) if self.cuts else [" " + text]

    def encoded(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A and B ids of every piece; B puts a space first by itself."""
        # the faster encoder's matcher looks ahead by recursion, too deep for white space without end
        a = [self.quick.encode_ordinary(x) if self.quick and len(x) <= 10_000 else self.a.encode(x, add_special_tokens=False).ids for x in pieces]
        b = self.b.encode([x[1:] if x[0] == " " else x for x in pieces], num_threads=1) if pieces else []
        return a, [[self.space] if x == " " else y if x[0] == " " else y[1:] for x, y in zip(pieces, b)]

    def grouped(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Of every piece whether both tokenizers give its bytes back (else it has no tokens), its A tokens, B tokens and groups;
        then the groups in a row, as numbers of the keys ``a1,a2|b1`` that come last."""
        a, b = self.encoded(pieces)
        same = lambda ids, known, raw: b"".join([known[i] for i in ids]) == raw
        good = np.array([same(x, self.a_bytes, p) and same(y, self.b_bytes, p) for x, y, p in zip(a, b, (p.encode() for p in pieces))], bool)
        a, b = ([x if ok else [] for x, ok in zip(side, good)] for side in (a, b))
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        a, b = (np.array([i for x in side for i in x], np.int64) for side in (a, b))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # all pieces in a row: both sides have the same bytes, so ends meet at the end of every piece and wherever a group ends
        ends = lambda own, others: own == others[np.minimum(np.searchsorted(others, own), len(others) - 1)] if len(own) else np.zeros(0, bool)
        in_a, in_b = ends(a_end, b_end), ends(b_end, a_end)
        size_a, size_b = (np.diff(np.flatnonzero(x), prepend=-1) for x in (in_a, in_b))
        from_a, from_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        groups = np.bincount(np.repeat(np.arange(len(pieces)), n_a)[from_a], minlength=len(pieces))
        number, ones = np.empty(len(size_a), np.int64), (size_a == 1) & (size_b == 1)
        pairs, number[ones] = np.unique(a[from_a[ones]] << 32 | b[from_b[ones]], return_inverse=True)
        keys = {f"{x >> 32}|{x & 0xFFFFFFFF}": i for i, x in enumerate(pairs.tolist())}
        a_text, b_text = (list(map(str, x.tolist())) for x in (a, b))
        more = np.flatnonzero(~ones)
        number[more] = [keys.setdefault(f"{','.join(a_text[i : i + n])}|{','.join(b_text[j : j + m])}", len(keys)) for i, n, j, m in zip(*(x[more].tolist() for x in (from_a, size_a, from_b, size_b)))]
        return good, n_a, n_b, groups, number, list(keys)

    def links(self, key: str) -> dict[tuple[int, int], int]:
        """How often each A id and B id of a group overlap."""
        a, b = ([int(x) for x in side.split(",")] for side in key.split("|"))
        out: dict[tuple[int, int], int] = {}
        i, j, a_end, b_end = 0, 0, len(self.a_bytes[a[0]]), len(self.b_bytes[b[0]])
        while True:
            out[a[i], b[j]] = out.get((a[i], b[j]), 0) + 1
            step_a, step_b = a_end <= b_end, b_end <= a_end
            i, j = i + step_a, j + step_b
            if i == len(a) or j == len(b):
                return out
            a_end += len(self.a_bytes[a[i]]) if step_a else 0
            b_end += len(self.b_bytes[b[j]]) if step_b else 0


BLOCK = pa.schema(
    [
        ("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())), ("n_groups", pa.list_(pa.int64())), ("sha", pa.list_(pa.string())),
        ("entries", pa.list_(pa.int64())), ("member", pa.binary()), ("times", pa.binary()), ("keys", pa.list_(pa.string())), ("freq", pa.list_(pa.int64())), ("held", pa.list_(pa.int64())),
    ]
)
BLOCK_DDL = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, sha array<string>, entries array<long>, member binary, times binary, keys array<string>, freq array<long>, held array<long>"


def _block(v: Vocabularies, block: int, ids: list, index: dict[str, int], docs: list[np.ndarray]) -> pa.RecordBatch:
    """One block: index numbers its distinct pieces, docs has every document's piece numbers."""
    good, n_a, n_b, size, flat, keys = v.grouped(list(index))
    first = np.cumsum(size) - size
    name = [keys[x] for x in flat.tolist()]
    text = [";".join(name[i : i + n]) for i, n in zip(first.tolist(), size.tolist())]
    docs = [d if good[d].all() else d[:0] for d in docs]
    n_docs, pieces = len(docs), np.concatenate([*docs, np.empty(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(n_docs), [len(d) for d in docs])
    per_doc = lambda x: np.bincount(of, x[pieces], n_docs).astype(np.int64)
    # the groups of every document, then each once with how often
    times = size[pieces]
    at = np.repeat(first[pieces] - np.cumsum(times) + times, times) + np.arange(times.sum())
    code, n = np.unique(np.repeat(of, times) * max(len(keys), 1) + flat[at], return_counts=True)
    doc, member = np.divmod(code, max(len(keys), 1))
    freq = np.bincount(member, n, len(keys)).astype(np.int64)
    sha = [hashlib.sha256(";".join([text[x] for x in d]).encode()).hexdigest() if len(d) else "" for d in (d.tolist() for d in docs)]
    row = [block, ids, per_doc(n_a), per_doc(n_b), per_doc(size), sha, np.bincount(doc, minlength=n_docs), member.astype("<i4").tobytes(), n.astype("<i4").tobytes(), keys, freq, np.bincount(member, minlength=len(keys))]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCK)], schema=BLOCK)


class Alignment:
    """The parts of an alignment over docs(doc_id, text), each a DataFrame.

    groups: key, freq, held (documents).  links: key, a, b, n, held.  pairs: a, b, n (documents), best (the highest n
    of a).  documents(): the sums of every document.
    """

    def __init__(self, docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, block_chars: int = BLOCK_CHARS):
        spark = docs.sparkSession
        files, name = spark.sparkContext.broadcast((Path(a_file).read_bytes(), Path(b_file).read_bytes())), (a_file, b_file)

        def vocabularies() -> Vocabularies:
            if name not in _loaded:
                _loaded[name] = Vocabularies(*files.value)
            return _loaded[name]

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            v = vocabularies()
            block, chars, ids, index, docs = TaskContext.get().partitionId() << 32, 0, [], {}, []
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    text = text.as_py()
                    if chars and chars + len(text or "") > block_chars:
                        yield _block(v, block, ids, index, docs)
                        block, chars, ids, index, docs = block + 1, 0, [], {}, []
                    chars += len(text or "") + 1
                    ids.append(doc_id.as_py())
                    docs.append(np.array([index.setdefault(x, len(index)) for x in v.pieces(text)] if text else [], np.int64))
            if ids:
                yield _block(v, block, ids, index, docs)

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = vocabularies()
            for batch in batches:
                rows = [(key, a, b, n, held) for key, held in zip(*(batch.column(i).to_pylist() for i in (0, 1))) for (a, b), n in v.links(key).items()]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)] if rows else [pa.array([], pa.string()), *[pa.array([], pa.int64())] * 4], names=["key", "a", "b", "n", "held"])

        self.blocks = written(docs.select("doc_id", "text").mapInArrow(encode, BLOCK_DDL), "blocks")
        by_block = self.blocks.select("block", F.posexplode(F.arrays_zip("keys", "freq", "held")).alias("i", "g"))
        # a group of documents without tokens alone is none
        self.by_block = by_block.select("block", "i", F.col("g.keys").alias("key"), "g.freq", "g.held").where("held > 0")
        self.groups = written(self.by_block.groupBy("key").agg(F.sum("freq").alias("freq"), F.sum("held").alias("held")), "groups")
        self.links = written(self.groups.select("key", "held").mapInArrow(expand, "key string, a long, b long, n long, held long"), "links")
        self.pairs = written(self._pairs(), "pairs")

    def _pairs(self) -> DataFrame:
        found = written(self.links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("groups"), F.sum("held").alias("n")), "found")
        alone = found.where("groups = 1").select("a", "b", "n")
        several = found.where("groups > 1").select("a", "b").hint("merge")
        shared = salted_join(self.links.select("key", "a", "b"), several, ["a", "b"], "key").groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
        # the planner can't know how long lists are and how many salts there will be, so it must not choose to broadcast them
        back = self.by_block.select("block", "i", "key").join(shared, "key").groupBy("block").agg(F.collect_list(F.struct("i", "pairs")).alias("shared")).hint("merge")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Documents of a block that have any of a pair's groups."""
            for batch in batches:
                for r in range(batch.num_rows):
                    entries, member = batch.column("entries")[r].values.to_numpy(), np.frombuffer(batch.column("member")[r].as_py(), "<i4")
                    of, shared = np.repeat(np.arange(len(entries)), entries), batch.column("shared")[r].values
                    i, lists = shared.field("i").to_numpy(), shared.field("pairs")
                    per_group, pairs = lists.value_lengths().to_numpy(), lists.flatten()
                    code = pairs.field("a").to_numpy() << 32 | pairs.field("b").to_numpy()
                    names, number = np.unique(code, return_inverse=True)
                    size, first = np.zeros(int(member.max(initial=0)) + 1, np.int64), np.zeros(int(member.max(initial=0)) + 1, np.int64)
                    size[i], first[i] = per_group, np.cumsum(per_group) - per_group
                    times = size[member]
                    at = np.repeat(first[member] - np.cumsum(times) + times, times) + np.arange(times.sum())
                    held = np.unique(np.repeat(of, times) * len(names) + number[at]) % len(names)
                    n = np.bincount(held, minlength=len(names))
                    yield pa.RecordBatch.from_arrays([pa.array(names >> 32), pa.array(names & 0xFFFFFFFF), pa.array(n)], names=["a", "b", "n"])

        unions = self.blocks.select("block", "entries", "member").join(back, "block").drop("block").mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        # an A id has at most as many pairs as B has ids
        return alone.unionByName(unions).withColumn("best", F.max("n").over(Window.partitionBy("a")))

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
        pairs = self.pairs.select("a", "b", F.col("n").alias("documents"), "best").hint("merge")
        linked = salted_join(self.links.select("key", "a", "b", "n"), pairs, ["a", "b"], "key")
        numbers = linked.groupBy("key").agg(F.sum("n").alias("links"), F.sum(F.when(F.col("documents") == F.col("best"), F.col("n")).otherwise(0)).alias("best"), F.sum(F.col("n") * F.col("documents")).alias("total"))
        back = self.by_block.select("block", "i", "key").join(numbers, "key").groupBy("block").agg(F.collect_list(F.struct("i", "links", "best", "total")).alias("numbers")).hint("merge")
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    own = {c: batch.column(c)[r].values for c in ("doc_id", "n_a", "n_b", "n_groups", "sha", "entries")}
                    member, times = (np.frombuffer(batch.column(c)[r].as_py(), "<i4") for c in ("member", "times"))
                    entries, got = own["entries"].to_numpy(), batch.column("numbers")[r].values
                    of, out = np.repeat(np.arange(len(entries)), entries), []
                    for c in ("links", "best", "total"):
                        value = np.zeros(int(member.max(initial=-1)) + 1, np.int64)
                        if got is not None:
                            value[got.field("i").to_numpy()] = got.field(c).to_numpy()
                        total = np.zeros(len(entries), np.int64)
                        np.add.at(total, of, value[member] * times)
                        out.append(pa.array(total))
                    yield pa.RecordBatch.from_arrays([own["doc_id"], own["n_a"], own["n_b"], own["n_groups"], *out, own["sha"]], names=names)

        return self.blocks.join(back, "block", "left").select("doc_id", "n_a", "n_b", "n_groups", "sha", "entries", "member", "times", "numbers").mapInArrow(sums, ", ".join(f"{c} {'string' if c == names[-1] else 'long'}" for c in names))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Alignment(table(spark, sf_dir, "documents")).documents()
