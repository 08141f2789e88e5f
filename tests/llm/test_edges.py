"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for each operator."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import ann, chat, exact_dup, line_dedup, mixing, near_dup, nbsvm, packing, sharding, warc

LONG = "word " * 60000
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, `__x.y` string, label int, score string, n_tokens string"
ROWS = [
    (1, "the same text here and there again", "en", "a", 34, "x", None, 1, "s", "t"),
    (2, "the same text here and there again", None, "a", None, None, "y", None, None, None),
    (2, "the same text here and there again", None, "a", None, None, "y", None, None, None),
    (3, None, "en", "a", None, "x", None, 1, "s", "t"),
    (4, "", "en", None, 0, "x", None, 1, "s", "t"),
    (5, "", "en", None, 0, "x", None, 1, "s", "t"),
    (6, LONG, "en", "b", len(LONG), "x", None, 1, "s", "t"),
    (7, " \n ", "en", "b", 3, "x", None, 1, "s", "t"),
    (None, "lost id", "en", "b", 7, "x", None, 1, "s", "t"),
    (8, "ünï çødé 漢字", "xx", "c", 12, "x", None, 1, "s", "t"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_owners(docs, none):
    assert sorted(map(tuple, exact_dup.exact_owners(docs).collect())) == [(2, 1), (5, 4)]
    assert exact_dup.exact_owners(none).collect() == []


def test_near_duplicates(docs, none):
    found = near_dup.near_duplicates(docs).collect()
    assert [(r.doc_id, r.keeper_id, r.jaccard) for r in found] == [(2, 1, 1.0)]
    assert near_dup.near_duplicates(none).collect() == []


def test_line_dedup(spark, docs, none):
    done = line_dedup.drop_boilerplate(docs, ratio=0.4)
    assert done.count() == len(ROWS)
    # Equal texts of a host are one page, so copies lose nothing for being copies.
    assert {r.doc_id: r.text for r in done.collect()} == {r[0]: r[1] for r in ROWS}
    assert set(done.columns) == set(docs.columns) | {"n_dropped"}
    assert line_dedup.drop_boilerplate(none).collect() == []


def test_the_ratio_alone_decides(spark):
    kind = "doc_id bigint, text string, source string, n_dropped string"
    rows = [(i, f"HEADER\nown line {i}", "small", "x") for i in range(4)] + [(10, "HEADER\nalone", "one", "x"), (11, "HEADER\nA", "two", "x"), (12, " HEADER \nB", "two", "x")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, kind)).collect()}
    assert got == {i: (f"own line {i}", 1) for i in range(4)} | {10: ("HEADER\nalone", 0), 11: ("A", 1), 12: ("B", 1)}
    half = [(i, "LINE\n" * (i < 4) + f"p{i}", "s", "x") for i in range(10)]
    dropped = lambda ratio: sum(r.n_dropped for r in line_dedup.drop_boilerplate(spark.createDataFrame(half, kind), ratio=ratio).collect())
    assert dropped(0.33) == 4 and dropped(0.34) == 0


CLASH = "__q_key __q_lines __q_host __q_kept __q_source __q_size __q_text __Q_row position shard epoch take start n_tokens n_dropped score kept".split()


def test_columns_of_any_name(spark, docs):
    """Names that the operators use themselves: kept as they are, but for those that an operator states it replaces."""
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumns({c: F.lit(c) for c in CLASH})

    def held(df, *replaced):
        assert set(df.columns) >= set(CLASH)
        rest = [c for c in CLASH if c not in replaced]
        assert {tuple(r) for r in df.select(*rest).collect()} == {tuple(rest)}

    held(line_dedup.drop_boilerplate(odd, ratio=0.1), "n_dropped")
    held(mixing.mix_to_budgets(odd, 0.5), "n_tokens", "epoch", "start", "take")
    held(sharding.stratified_shards(odd, 3), "position", "shard")
    labels = spark.createDataFrame([(1, 1), (6, 0)], "doc_id bigint, quality int")
    held(nbsvm.classify(odd, labels, keep=("doc_id", *CLASH)), "score", "kept")
    assert packing.pack(packing.document_examples(odd).withColumns({"group": F.lit(1), "key": F.lit("k"), "bin": F.lit(2)})).count() > 0
    assert {tuple(r) for r in exact_dup.exact_owners(odd.withColumns({c: F.lit(1) for c in ("n", "h", "trie", "salt", "owner")})).collect()} == {(2, 1), (5, 4)}
    assert [r.doc_id for r in near_dup.near_duplicates(odd.withColumns({c: F.lit(1) for c in ("size", "f1", "keys", "task", "component")})).collect()] == [2]


def test_ids_of_any_type(spark, docs):
    """Ids that are strings: the same results by another name."""
    named = docs.withColumn("doc_id", F.concat(F.lit("urn:x:"), F.col("doc_id").cast("string")))
    assert sorted(map(tuple, exact_dup.exact_owners(named).collect())) == [("urn:x:2", "urn:x:1"), ("urn:x:5", "urn:x:4")]
    assert [tuple(r)[:2] for r in near_dup.near_duplicates(named).collect()] == [("urn:x:2", "urn:x:1")]
    assert {r.id for r in packing.pack(packing.document_examples(named)).collect()} == {None, *(f"urn:x:{i}" for i in (1, 2, 6, 8))}
    assert sharding.stratified_shards(named, 3).count() == len(ROWS)
    # The source of the two empty texts has no tokens.
    assert mixing.mix_to_budgets(named, 1.0).count() == len(ROWS) - 2
    labels = spark.createDataFrame([("urn:x:1", 1), ("urn:x:6", 0)], "doc_id string, quality int")
    assert {r.doc_id: r.kept for r in nbsvm.classify(named, labels).collect()}["urn:x:6"] is False


def test_pipeline_stages_with_clashing_columns(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (6, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumns({c: F.lit(c) for c in CLASH})
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, odd, str(tmp_path))
        done.collect()
        assert name == "packing" or done.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_near_dedup_of_repeated_rows(spark, docs):
    """Rows that repeat an id are one document."""
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    again = docs.unionByName(docs.where("doc_id = 1"))
    assert sum(r.doc_id == 1 for r in corpus_pipeline.drop_near_copies(spark, again, "").collect()) == 2


def test_mixing(docs, none):
    rows = mixing.mix_to_budgets(docs.withColumnRenamed("score", "start"), 0.5).collect()
    by = Counter()
    for r in rows:
        by[r.source] += r.take
    total = sum(by.values())
    words = Counter()
    for r in ROWS:
        words[r[3]] += len((r[1] or "").split())
    weight = {s: n**0.5 for s, n in words.items() if n}
    assert by == {s: round(sum(words.values()) * w / sum(weight.values())) for s, w in weight.items()}
    assert abs(total - sum(words.values())) <= 3
    assert mixing.mix_to_budgets(none, 0.5).collect() == []


def test_cut_texts(docs):
    mixed = mixing.mix_to_budgets(docs, 0.5)
    for r in mixing.cut_texts(mixed).collect():
        assert len((r.text or "").split()) == r.take
        assert r.take == r.n_tokens or r.n_chars == len(r.text)


def test_sharding(docs, none):
    rows = sharding.stratified_shards(docs, 3).collect()
    assert sorted(r.position for r in rows) == list(range(len(ROWS)))
    assert all(r.shard == r.position * 3 // len(ROWS) for r in rows)
    assert sharding.stratified_shards(none, 3).collect() == []


def test_packing(spark, docs, none):
    rows = packing.pack(packing.document_examples(docs), tokens=100, segments=4, loss=90).collect()
    assert sum(r.n_tokens for r in rows) == sum(len((r[1] or "").split()) for r in ROWS)
    odd = spark.createDataFrame([(None, [3], [True]), (1, None, [True]), (2, [None, 5], [None, True]), (3, [], []), (4, [-2, 7], [True, None])], "id bigint, lengths array<bigint>, bears array<boolean>")
    assert sorted((r.id or 0, r.n_tokens, r.n_loss) for r in packing.pack(odd).collect()) == [(0, 3, 3), (2, 5, 5), (4, 7, 0)]
    assert packing.pack(packing.document_examples(none)).collect() == []


def test_packing_conversations(spark):
    rows = [(1, 0, "user", "a b"), (1, 1, "assistant", "c d e"), (1, 1, "assistant", "c d e"), (2, None, None, None), (None, 0, "user", "x"), (3, 0, "assistant", "")]
    made = packing.conversation_examples(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert {r.id: (r.lengths, r.bears) for r in made.collect()} == {1: ([2, 3], [False, True]), 2: ([0], [False]), 3: ([0], [True])}


def test_classifier(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (6, 0, 0), (6, 0, 0), (8, 1, 0), (8, 0, 0), (None, 1, 0), (7, None, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    done = nbsvm.classify(docs, labels).collect()
    assert len(done) == len(ROWS)
    kept = {r.doc_id: r.kept for r in done}
    assert kept[1] and not kept[6] and kept[3] and kept[4] and kept[7]
    assert all(r.kept and r.score == 0 for r in nbsvm.classify(docs, labels.limit(0)).collect())
    assert nbsvm.classify(none, labels).collect() == []


def test_chat(spark):
    kind = "conv_id bigint, turn bigint, role string, text string, chosen string"
    rows = [(1, 0, "user", "hi <|end|>", "z"), (1, 1, "assistant", "yes", None), (2, 0, None, None, None), (2, 1, "assistant", "no", None), (2, 1, "assistant", "no", None), (None, 0, "user", "x", None)]
    done = chat.format_preferences(chat.spliced_pairs(spark.createDataFrame(rows, kind))).collect()
    assert len(done) == 1
    r = done[0]
    assert (r.pair_id, r.prefix_turns, r.prompt) == (1, 1, "<|user|>\nhi <\\|end|><|end|>\n")
    assert r.chosen == "<|assistant|>\nyes<|end|>\n" and r.rejected == "<|assistant|>\nno<|end|>\n"
    a, b = map(int, r.chosen_loss.split("-"))
    assert r.chosen[a:b] == "yes<|end|>"
    assert chat.format_preferences(chat.spliced_pairs(spark.createDataFrame([], kind))).collect() == []
    turn = "array<struct<turn:bigint,role:string,text:string>>"
    same = spark.createDataFrame([(1, [(0, "user", "a")], [(5, "user", "a")]), (2, None, [(0, None, None)]), (3, [(0, "user", "a"), (1, "assistant", "b" * 300000)], [(0, "user", "a")])], f"pair_id bigint, chosen {turn}, rejected {turn}")
    got = {r.pair_id: r for r in chat.format_preferences(same).collect()}
    assert (got[1].prefix_turns, got[1].chosen, got[1].rejected, got[1].chosen_loss) == (1, "", "", "")
    assert (got[2].prefix_turns, got[2].prompt, got[2].rejected) == (0, "", "<|user|>\n<|end|>\n")
    assert got[3].rejected == "" and got[3].chosen_loss == f"14-{14 + 300000 + 7}"


def test_chat_of_ids_with_gaps(spark):
    """The partner is the next conversation there is, whatever the ranges and the type of ids."""
    rows = [(i * 7 if i < 50 else i * 1000, t, None if t % 3 else "assistant", f"text {i} {t}") for i in range(100) for t in range(i % 5 + 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    plain: dict = {}
    for c, t, role, text in rows:
        plain.setdefault(c, []).append((t, role or "user", text))
    ids = sorted(plain)
    wanted = {a: (plain[a], plain[a][: -(-len(plain[a]) // 2)] + plain[b][-(-len(plain[a]) // 2) :]) for a, b in zip(ids, ids[1:])}
    named = df.withColumn("conv_id", F.concat(F.lit("c\"'"), F.lpad(F.col("conv_id").cast("string"), 9, "0")))
    for per_range in (1, 3, 256):
        got = {r.pair_id: ([tuple(x) for x in r.chosen], [tuple(x) for x in r.rejected]) for r in chat.spliced_pairs(df, per_range).collect()}
        assert got == wanted
        by_name = [[tuple(x) for x in r.rejected] for r in chat.spliced_pairs(named, per_range).orderBy("pair_id").collect()]
        assert by_name == [wanted[i][1] for i in ids[:-1]]


def test_chat_with_a_null_turn_and_one_before_all(spark):
    rows = [(1, None, "user", "null"), (1, -1, "user", "minus"), (1, -(1 << 63) + 1, "user", "least")]
    turns = chat.turn_rows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("turn").collect()
    assert [r.text for r in turns] == ["null", "least", "minus"]


def test_revisits_of_named_records(spark):
    """Ids as crawlers write them, and URLs that are null or empty."""
    kind = "record_id string, url string, ts bigint, warc_type string, headers map<string,string>, payload string"
    rows = [
        ("<urn:uuid:a>", "http://a.com/", 10, "response", {"ETag": "1"}, "A"),
        ("<urn:uuid:b>", "http://a.com/", 10, "response", {"ETag": "1"}, "B"),
        ("<urn:uuid:c>", "http://a.com/", 20, "revisit", {"etag": "1"}, None),
        ("<urn:uuid:d>", None, 20, "revisit", {"etag": "1"}, None),
        ("<urn:uuid:e>", "  ", 20, "revisit", {"etag": "1"}, None),
        ("<urn:uuid:f>", None, 10, "response", {"ETag": "1"}, "F"),
    ]
    got = {r.record_id[10]: (r.outcome, r.response_id, r.payload) for r in warc.resolve_revisits(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"c": ("resolved", "<urn:uuid:b>", "B"), "d": ("no_response", None, None), "e": ("no_response", None, None)}


def test_revisits(spark):
    kind = "record_id bigint, url string, ts bigint, warc_type string, headers map<string,string>, payload string, h string, canonical string"
    more = (None, "clash")
    rows = [
        (1, "http://www.A.com:80/p/?utm_x=1&b=2#f", 10, "response", {"ETag": '"1"', "Content-Length": "9", "X": "old"}, "body", *more),
        (2, "https://a.com/p?b=2", 20, "response", {"ETag": '"2"', "Last-Modified": "d"}, "later", *more),
        (2, "https://a.com/p?b=2", 20, "response", {"ETag": '"2"', "Last-Modified": "d"}, "later", *more),
        (3, "http://a.com/p?b=2", 15, "revisit", {"etag": 'W/"1"', "Content-Length": "0", "x": "new"}, None, *more),
        (4, "http://a.com/p?b=2", 30, "revisit", {"etag": '"1"'}, None, *more),
        (5, "http://a.com/p?b=2", 20, "revisit", {"etag": '"1"'}, None, *more),
        (6, "http://a.com/p?b=2", 40, "revisit", None, None, *more),
        (7, "http://other.com/", 40, "revisit", None, None, *more),
        (8, None, 40, "revisit", None, None, *more),
        (9, "http://a.com/p?b=2", None, "revisit", None, None, *more),
        (10, "http://a.com/p?b=2", 50, None, None, None, *more),
        (11, "http://a.com/p?b=2", 60, "revisit", {"Last-Modified": "d"}, None, *more),
    ]
    done = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, kind)).collect()}
    assert {k: (r.outcome, r.response_id) for k, r in done.items()} == {3: ("resolved", 1), 4: ("mismatch", 2), 5: ("resolved", 1), 6: ("unvalidated", 2), 7: ("no_response", None), 8: ("no_response", None), 9: ("no_response", None), 11: ("resolved", 2)}
    assert done[3].headers == 'content-length: 9\netag: W/"1"\nx: new' and done[3].payload == "body"
    assert done[11].payload == "later" and done[4].payload is None
    assert warc.resolve_revisits(spark.createDataFrame([], kind)).collect() == []


def test_nearest(spark):
    kind = "vec_id bigint, embedding array<float>, rank string, id string"
    vectors = [[1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [1.0, 1.0], None, [], [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [1.0, 2.0, 3.0]]
    rows = [(i, v, "r", None) for i, v in enumerate(vectors)] + [(None, [1.0, 1.0], "r", None), (0, [1.0, 0.0], "r", None)]
    done = ann.nearest_neighbours(spark.createDataFrame(rows, kind), k=2).collect()
    got = {(r.vec_id, r["rank"]): r.neighbour_id for r in done}
    assert got == {(0, 1): 1, (0, 2): 3, (1, 1): 0, (1, 2): 3, (2, 1): 3, (2, 2): 0, (3, 1): 0, (3, 2): 1}
    assert ann.nearest_neighbours(spark.createDataFrame([], kind)).collect() == []
