"""The stored index against plain counting: whole fallbacks, odd keys, generations, and what a build moves."""

import pytest

from quernstone.operators import search
from quernstone.operators import stored_index
from quernstone.operators.stored_index import DOCS, StoredIndex


def index_of(spark, folder, rows):
    return StoredIndex(spark, str(folder)).rebuild(spark.createDataFrame(rows, DOCS))


def test_fallback_is_whole_where_no_limit_is_asked_for(spark, tmp_path):
    """more than 100 texts hold the query within a word."""
    rows = [(f"k{n}", "t", "title", "xx" + "needle" * (1 + n % 3) + "yy") for n in range(130)]
    index = index_of(spark, tmp_path, rows + [(f"o{n}", "t", None, "other") for n in range(300)])
    found = index.search("needle", limit=None, candidates=None).collect()
    assert {r.key for r in found} == {r[0] for r in rows} and len(found) == 130
    assert index.search("needle").count() == 20
    assert {r.key: round(r.score, 9) for r in search.search(search.index(index.documents()), "needle", limit=None, candidates=None).collect()} == {r.key: round(r.score, 9) for r in found}


def test_overlapping_parts_are_counted(spark):
    from pyspark.sql import functions as F

    from quernstone.functions.text import substring_count

    made = spark.createDataFrame([("aaaa",), ("a\\Eb.a\\Eb",), ("",), ("xay",)], "t string").select(substring_count(F.col("t"), "aa"), substring_count(F.col("t"), "a\\eb".replace("e", "E")), substring_count(F.col("t"), "b.a")).collect()
    assert [tuple(r) for r in made] == [(3, 0, 0), (0, 2, 1), (0, 0, 0), (0, 0, 0)]


@pytest.mark.parametrize("words", [1, 7, 1 << 21])
def test_postings_of_runs(spark, tmp_path, monkeypatch, words):
    """F2 to F6: postings are sorted where the documents are, in runs of any length."""
    monkeypatch.setattr(stored_index, "RUN_WORDS", words)
    rows = [(f"k{n}", None if n % 5 == 0 else "t", ["Ä b", "", None][n % 3], " ".join(["b", "c", "Ä", "c"][: n % 5]) or None) for n in range(40)]
    index = index_of(spark, tmp_path, rows)
    wanted = set()
    for key, kind, title, text in rows:
        sides = [(x or "").lower().replace("ä", "a").split() for x in (title, text)]
        for w in {*sides[0], *sides[1]}:
            wanted.add((w, key, kind, len(sides[0]) + len(sides[1]), *(tuple(i for i, x in enumerate(s) if x == w) for s in sides)))
    got = {(r.term, r.key, r.type, r.size, tuple(r.in_title), tuple(r.in_text)) for r in index.postings(["a", "b", "c"]).collect()}
    assert got == wanted
    assert {r.key for r in index.fetch(["k3", "k39", "no"]).collect()} == {"k3", "k39"}
    assert index.state()["n"] == 40 and index.state()["size"] == sum(len((x or "").split()) for r in rows for x in r[2:])


def test_repeated_keys_and_generations(spark, tmp_path):
    index = index_of(spark, tmp_path, [("a", "t", "one", "x"), ("a", "t", "two", "x"), ("b", "t", "b", "y"), (None, "t", "n", "x")])
    assert [(r.key, r.title) for r in index.documents().orderBy("key").collect()] == [("a", "two"), ("b", "b")]
    index.apply(spark.createDataFrame([(1, "put", "b", "t", "b", "x x"), (2, "delete", "b", None, None, None), (3, "put", "c", "u", "c", "x")], f"seq long, op string, {DOCS}"))
    assert {r.key for r in index.word_hits(["x"]).collect()} == {"a", "c"} and index.state()["n"] == 2
    index.rebuild()
    assert {r.key for r in index.word_hits(["x"]).collect()} == {"a", "c"} and index.state()["n"] == 2
    assert index_of(spark, tmp_path / "none", []).word_hits(["x"]).count() == 0


def test_a_build_shuffles_its_documents_alone(spark, tmp_path):
    """F2 to F6: what a build shuffles is a few times its texts, not its postings row by row."""
    rows = [(f"k{n}", "t", "s", " ".join(f"w{(n * 31 + i * i) % 997}" for i in range(400))) for n in range(200)]
    store = spark.sparkContext._jsc.sc().statusStore()
    moved = lambda: sum(s.shuffleWriteBytes() + s.diskBytesSpilled() for s in _stages(spark, store))
    before = moved()
    index_of(spark, tmp_path, rows)
    assert moved() - before < 2 * sum(len(r[3]) for r in rows)


def _stages(spark, store):
    listed = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return [listed.apply(i) for i in range(listed.size())]
