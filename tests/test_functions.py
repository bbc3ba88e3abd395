import posixpath

import pytest
from pyspark.sql import functions as F

from tidemark.functions import strings, values


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


L = F.lit


def test_logic_is_left_to_right(spark):
    null = L(None).cast("boolean")
    assert one(spark, values.and_(L(False), null), values.and_(null, L(False)), values.or_(L(True), null), values.or_(null, L(True)), values.passes(null)) == (False, None, True, None, False)
    assert one(spark, values.same(L(None), L(None)), values.same(L(1), L(None))) == (True, False)


def test_numbers(spark):
    assert one(spark, values.int_divide(L(-7), L(2)), values.int_modulo(L(-7), L(2)), values.int_divide(L(1), L(0)), values.int_modulo(L(1), L(0)), values.double_modulo(L(7.9), L(2.5)), values.double_modulo(L(7.9), L(0.5))) == (-3, -1, None, None, 1, None)
    assert one(spark, values.number_or_one(L("2.5")), values.number_or_one(L("x")), values.number_or_one(L(None).cast("string"))) == (2.5, 1.0, None)


@pytest.mark.parametrize("start,stop", [(None, None), (1, None), (None, 2), (1, -1), (-2, None), (3, 1), (0, 9), (-9, 2)])
def test_slices_are_python_slices(spark, start, stop):
    items = [1, 2, 3, 4]
    assert one(spark, values.cut(F.array(*map(L, items)), start, stop))[0] == items[start:stop]


def test_items_ranges_objects(spark):
    a = F.array(L(1), L(2), L(3))
    assert one(spark, values.item(a, 0), values.item(a, -1), values.item(a, 3), values.item(a, -4)) == (1, 3, None, None)
    assert one(spark, values.half_open_range(L(0), L(5), 2), values.half_open_range(L(5), L(0), -2), values.half_open_range(L(5), L(0)), values.half_open_range(L(2), L(2))) == ([0, 2, 4], [5, 3, 1], [], [])
    x, y = F.create_map(L("a"), L("1"), L("b"), L("2")), F.create_map(L("b"), L("9"))
    assert one(spark, values.merge_objects(x, y), values.without(x, "a")) == ({"a": "1", "b": "9"}, {"b": "2"})
    assert one(spark, *[values.json_type(L(t)) for t in ("null", "true", "-3", "1.5e3", "[1]", "{}", '"s"')]) == ("null", "boolean", "integer", "double", "array", "object", "string")


@pytest.mark.parametrize("path", ["/a/b/c", "a/b/", "/a", "a", "/", "//", "a//b", "/a//"])
def test_paths(spark, path):
    clean = path.rstrip("/") or "/"
    base, parent = one(spark, strings.basename(L(path)), strings.dirname(L(path)))
    assert base == (posixpath.basename(clean) or "/") and parent == (posixpath.dirname(clean) or ".")


def test_strings(spark):
    assert one(spark, strings.basename(L("/x/y.txt"), ".txt"), strings.join(F.array(L("a"), L("b"))), strings.shell_escape(L('a"$b`\\')), strings.template("{x}-{{y}}", x=L(3))) == ("y", "a b", '"a\\"\\$b\\`\\\\"', "3-{y}")
    assert one(spark, strings.fnmatch(L("abc.txt"), "*.t?t"), strings.fnmatch(L("abc.txt"), "b*")) == (True, False)
    assert one(spark, strings.byte_size(L(1536)), strings.byte_size(L(0)), strings.byte_size(L(1 << 40))) == ("1.50 KB", "0.00 B", "1.00 TB")
    assert one(spark, *[strings.fnmatch(L(x), "x[!ab]?") for x in ("xc1", "xa1", "x!1")], strings.fnmatch(L("a]b"), "a[]]b"), strings.fnmatch(L("a^"), "a[^]"), strings.fnmatch(L("a[b"), "a[b")) == (True, False, True, True, True, True)
    for wrong in ("{nope}", "a { b", "a }"):
        with pytest.raises(ValueError):
            strings.template(wrong)


@pytest.mark.parametrize("v", [0.1, 1.0, 100000.0, 1e6, 123456789.0, 1.5e-5, 0.0001, -2.5])
def test_printf_general_prints_like_c(spark, v):
    assert one(spark, strings.printf("%g|%.3g|%d%%", L(v), L(v), L(7)))[0] == "%g|%.3g|7%%" % (v, v)


def test_printf_arity(spark):
    for args in ((), (L(1), L(2))):
        with pytest.raises(ValueError):
            strings.printf("%d", *args)


def test_durations_and_times():
    assert [strings.duration(x) for x in ("5", "5s", "2m", "1h", "1d")] == [5, 5, 120, 3600, 86400]
    assert strings.epoch("1970-01-02") == 86400 and strings.epoch("1970-01-01 00:59:59") == 3599 and strings.epoch("2w", now=2_000_000) == 2_000_000 - 1_209_600
    with pytest.raises(ValueError):
        strings.epoch("yesterday")
