"""Operators that SQL can't express, against brute force, and held-out accuracy."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import ann, exact_dup, near_dup, nbsvm, packing
from quernstone.llm.common import table
from quernstone.llm.components import connected_components
from quernstone.llm.queries import oracle_sql, queries

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def bag(text: str) -> Counter:
    words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def groups(bags: dict[int, Counter], threshold: float) -> dict[int, int]:
    head = {i: i for i in bags}

    def root(i: int) -> int:
        while head[i] != i:
            i = head[i]
        return i

    where: dict = {}
    for i, b in bags.items():
        for s in b:
            where.setdefault(s, []).append(i)
    pairs = {(x, y) for found in where.values() for x in found for y in found if x < y}
    for x, y in pairs:
        if similarity(bags[x], bags[y]) >= threshold:
            a, b = sorted((root(x), root(y)))
            head[b] = a
    return {i: root(i) for i in bags}


def test_near_duplicates_are_those_of_all_pairs(spark):
    rows = table(spark, MIDDLE, "documents").select("doc_id", "text").collect()
    bags = {r.doc_id: b for r in rows if (b := bag(r.text))}
    wanted = {(i, k) for i, k in groups(bags, 0.55).items() if i != k}
    found = {(r.doc_id, r.keeper_id) for r in near_dup.near_duplicates(table(spark, MIDDLE, "documents")).collect()}
    assert found <= wanted
    assert len(found & wanted) >= 0.95 * len(wanted)
    sure = {(i, k) for i, k in groups(bags, 0.8).items() if i != k}
    assert {i for i, _ in sure} <= {i for i, _ in found}


def test_chunks_of_a_component_lose_no_link(spark):
    docs = table(spark, MIDDLE, "documents").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("doc_id"), "text")
    whole = {tuple(r)[:2] for r in near_dup.near_duplicates(docs).collect()}
    assert whole and whole == {tuple(r)[:2] for r in near_dup.near_duplicates(docs, features_per_task=300).collect()}


def test_a_hot_text_and_a_long_chain(spark):
    """100,000 copies of a text are one document to all that follows; a chain of texts is one group through its links alone."""
    hot = "a text of some words that is on every page of a large site and never changes at all"
    chain = [" ".join(f"w{j}" for j in range(i, i + 30)) for i in range(0, 200, 4)]
    rows = spark.range(100_000).selectExpr("id AS doc_id", f"'{hot}' AS text").unionByName(spark.createDataFrame([(200_000 + i, t) for i, t in enumerate(chain)], "doc_id bigint, text string"))
    got = {r.doc_id: r.keeper_id for r in near_dup.near_duplicates(rows, features_per_task=200).collect()}
    assert all(got[i] == 0 for i in range(1, 100_000)) and 0 not in got
    assert {got[200_000 + i] for i in range(1, len(chain))} == {200_000}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_components_in_rounds_and_in_one_task(spark, kind):
    random = np.random.default_rng(6)
    ids = [f"n{i:03d}" if kind == "string" else i for i in range(120)]
    edges = [(ids[a], ids[b]) for a, b in random.integers(0, 120, (90, 2))] + [(ids[0], None), (ids[5], ids[5])] + list(zip(ids[60:90], ids[61:91]))
    head = {x: x for e in edges if None not in e for x in e}
    for _ in head:
        for a, b in edges:
            if b is not None:
                head[a] = head[b] = min(head[a], head[b])
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}")
    for one_task in (0, 1 << 19):
        labels, n = connected_components(df, one_task)
        assert {r.id: r.component for r in labels.collect()} == head and n == len(head)


def test_bag_minhash_is_unbiased():
    random = np.random.default_rng(5)
    features = random.integers(1, 1 << 44, 60).astype(np.uint64)
    a, b = random.integers(0, 9, 60), random.integers(0, 9, 60)
    text = np.concatenate([np.zeros((a > 0).sum()), np.ones((b > 0).sum())]).astype(np.int64)
    feature, count = np.concatenate([features[a > 0], features[b > 0]]), np.concatenate([a[a > 0], b[b > 0]])
    least = near_dup.bag_minhash(text, feature, count, 2, 4096)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((least[0] == least[1]).mean() - true) < 0.03


def test_trie_owners():
    random = np.random.default_rng(2)
    keys = [bytes(random.integers(97, 99, random.integers(0, 7)).tolist()) for _ in range(300)]
    trie = exact_dup.Patricia()
    for i, key in enumerate(keys):
        trie.insert(key, 1000 - i)
    assert {k: n.owner for k, n in trie.terminals()} == {k: min(1000 - i for i, x in enumerate(keys) if x == k) for k in keys}


def test_spilling_gives_subtrees_out_and_frees_them():
    random = np.random.default_rng(4)
    trie, keys = exact_dup.Patricia(), {b"/common/" + bytes(random.integers(97, 101, 12).tolist()) for _ in range(500)}
    for i, key in enumerate(sorted(keys)):
        trie.insert(key, i)
    was = trie.bytes
    out = {k: n.owner for k, n in trie.spill(was // 2)}
    left = {k: n.owner for k, n in trie.terminals()}
    assert out and left and not set(out) & set(left)
    assert out | left == {k: i for i, k in enumerate(sorted(keys))}
    assert was // 8 < trie.bytes <= was // 2


SPILLS = [{}, {"trie_bytes": 3000}, {"rows_per_key": 7}, {"trie_bytes": 2000, "rows_per_key": 7}, {"digest": lambda c: F.lit(7).cast("bigint")}, {"digest": lambda c: F.lit(7).cast("bigint"), "trie_bytes": 1500, "rows_per_key": 9}]


@pytest.mark.parametrize("settings", SPILLS, ids=range(len(SPILLS)))
def test_owners_by_brute_force(spark, settings):
    """Spills, hot keys and hashes that all collide, on string ids."""
    random = np.random.default_rng(8)
    texts = ["".join(random.choice(["a", "b"], random.integers(0, 8))) for _ in range(300)] + ["same"] * 100
    rows = [(f"k{i:04d}", t) for i, t in enumerate(texts)] + [("x", None)]
    first: dict = {}
    for i, t in rows:
        first.setdefault(t, i)
    found = exact_dup.exact_owners(spark.createDataFrame(rows, "doc_id string, text string"), **settings).collect()
    assert sorted(map(tuple, found)) == sorted((i, first[t]) for i, t in rows if first[t] != i)


def plain_bins(sizes, limits, window):
    """The dot-product heuristic item by item, over a window that is refilled."""
    demand = [[s / m for s, m in zip(row, limits)] for row in sizes]
    coming = list(range(len(sizes)))
    open_, coming = coming[:window], coming[window:]
    mean = [sum(c) / len(c) for c in zip(*(demand[i] for i in open_))]
    placed, number, slot, left = {}, 0, 0, list(limits)
    while open_:
        fit = [i for i in open_ if all(s <= x for s, x in zip(sizes[i], left))]
        if not fit:
            number, slot, left = number + 1, 0, list(limits)
            continue
        best = max(fit, key=lambda i: (round(sum(d * m * x / y for d, m, x, y in zip(demand[i], mean, left, limits)), 12), -i))
        placed[best] = (number, slot)
        slot, left = slot + 1, [x - s for x, s in zip(left, sizes[best])]
        open_.remove(best)
        if coming:
            open_.append(coming.pop(0))
    return placed


@pytest.mark.parametrize("window", [1, 7, 40, 500])
@pytest.mark.parametrize("seed", range(3))
def test_bins_are_those_of_the_plain_heuristic(seed, window):
    random = np.random.default_rng(seed)
    n = 80
    tokens = random.integers(1, 400, n)
    sizes = np.stack([tokens, np.ones(n, np.int64), np.minimum(tokens, random.integers(0, 300, n))], axis=1)
    limits = np.array([1000, 5, 700])
    bins, got = packing.Bins(limits, window), {}
    for row in sizes:
        placed = bins.add(tuple(row))
        if placed:
            got[placed[0]] = placed[1:]
    got |= {i: (b, slot) for i, b, slot in bins.finish()}
    assert got == plain_bins(sizes.tolist(), limits.tolist(), window)


def test_packing_by_brute_force(spark):
    """The whole query in plain Python: pieces, groups, order and bins."""
    examples = packing.conversation_examples(table(spark, MIDDLE, "conversations"))
    groups = 3
    key = F.xxhash64(F.lit(1), "id", "lengths")
    rows = examples.withColumns({"key": key, "group": F.pmod(key, F.lit(groups))}).orderBy("group", "key", "id").collect()
    wanted = set()
    for g in range(groups):
        pieces = []
        for r in rows:
            if r.group == g:
                flat = [b for n, b in zip(r.lengths, r.bears) for _ in range(n)]
                first, n, bear, k = 0, 0, 0, 0
                for b in flat:
                    if n == 300 or (b and bear == 200):
                        pieces.append((r.id, k, first, n, bear))
                        first, n, bear, k = first + n, 0, 0, k + 1
                    n, bear = n + 1, bear + b
                if n:
                    pieces.append((r.id, k, first, n, bear))
        placed = plain_bins([(p[3], 1, p[4]) for p in pieces], (300, 4, 200), 16)
        wanted |= {(*pieces[i], (g << 32) + b, slot) for i, (b, slot) in placed.items()}
    got = packing.pack(examples, 300, 4, 200, window=16, group_rows=-(-len(rows) // groups)).collect()
    assert len(got) == len(wanted) and set(map(tuple, got)) == wanted


def test_packing_holds_every_token_within_limits(spark):
    source = table(spark, MIDDLE, "conversations")
    wanted = {r.id: (sum(r.lengths), sum(n for n, b in zip(r.lengths, r.bears) if b)) for r in packing.conversation_examples(source).collect()}
    rows = packing.pack(packing.conversation_examples(source), 300, 4, 200).collect()
    got, loss, bins = Counter(), Counter(), {}
    for r in rows:
        got[r.id] += r.n_tokens
        loss[r.id] += r.n_loss
        bins.setdefault(r.bin, []).append(r)
    assert {i: (got[i], loss[i]) for i in wanted} == wanted
    assert all(sum(r.n_tokens for r in b) <= 300 and len(b) <= 4 and sum(r.n_loss for r in b) <= 200 for b in bins.values())
    assert all(sorted(r.slot for r in b) == list(range(len(b))) for b in bins.values())


def test_coordinate_descent_reaches_the_optimum():
    random = np.random.default_rng(3)
    x = random.normal(size=(40, 5))
    y = np.where(x[:, 0] + 0.3 * random.normal(size=40) > 0, 1.0, -1.0)
    starts, features = np.arange(0, 201, 5), np.tile(np.arange(5), 40)
    w = nbsvm.dual_coordinate_descent(starts, features, x.reshape(-1), y, 5, 1.0, 400, 1)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v[:5] + v[5])).sum()
    assert all(loss(w) <= loss(w + 0.05 * random.normal(size=6)) + 1e-3 for _ in range(300))


def test_ratios_are_those_of_counts():
    counts = np.array([[3, 0, 1], [1, 2, 1]])
    shares = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    assert np.allclose(nbsvm.log_count_ratios(counts, 1.0), np.log(shares[1] / shares[0]))


def plain_indicators(text: str) -> set:
    """Runs of one or two words and of one or two separators."""
    words = [(m.group().lower() if m.group().isascii() else "".join(c.lower() if c.isascii() else c for c in m.group()), m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    gaps = [text[a[2] : b[1]] for a, b in zip(words, words[1:])] + ([text[words[-1][2] :]] if words else [])
    names = [w for w, _, _ in words]
    return {("w", w) for w in names} | {("ww", *p) for p in zip(names, names[1:])} | {("g", g) for g in gaps} | {("gg", *p) for p in zip(gaps, gaps[1:])}


def test_classifier_by_brute_force(spark):
    """Indicators, class counts, ratios, descent and scores in plain Python: the same scores for every document, but for features that share a hash."""
    rows = [r for r in table(spark, SMALL, "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    feats = {r.doc_id: plain_indicators(r.text or "") for r in rows}
    names = sorted(set().union(*feats.values()))
    number = {n: i for i, n in enumerate(names)}
    counts = np.zeros((2, len(names)))
    for i, q in labels.items():
        counts[q, [number[f] for f in feats[i]]] += 1
    # The features that no document has count in the smoothing of the hashed model too.
    shares = counts + 1
    shares = shares / (counts.sum(axis=1, keepdims=True) + (1 << 22))
    ratio = np.log(shares[1] / shares[0])
    taught = sorted(labels)
    lists = [sorted(number[f] for f in feats[i]) for i in taught]
    starts = np.append(0, np.cumsum([len(x) for x in lists]))
    flat = np.concatenate([np.array(x, np.int64) for x in lists])
    norm = {i: np.sqrt(sum(ratio[number[f]] ** 2 for f in feats[i])) or 1.0 for i in feats}
    values = np.concatenate([ratio[np.array(x, np.int64)] / norm[i] for i, x in zip(taught, lists)])
    settings = nbsvm.Settings(bits=22, epochs=200)
    w = nbsvm.dual_coordinate_descent(starts, flat, values, np.where([labels[i] for i in taught], 1.0, -1.0), len(names), 1.0, 200, 1)
    wanted = {i: sum(w[number[f]] * ratio[number[f]] for f in feats[i]) / norm[i] + w[-1] for i in feats}
    got = {r.doc_id: r.score for r in nbsvm.classify(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"), settings).collect()}
    assert got.keys() == wanted.keys()
    # One in forty features shares its hash at 22 bits.
    assert max(abs(got[i] - wanted[i]) for i in wanted) < 0.05
    assert sum((got[i] >= 0) == (wanted[i] >= 0) for i in wanted) >= 0.99 * len(wanted)


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    labels = table(spark, d, "labels")
    done = nbsvm.classify(table(spark, d, "documents"), labels.where("doc_id % 4 <> 0"))
    right = done.join(labels.where("doc_id % 4 = 0"), "doc_id").agg(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int")))).first()
    assert right[0] > 0.98 and right[1] > 0.99


def test_nearest_against_all_pairs(spark):
    rows = table(spark, SMALL, "embeddings").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in rows])
    s = x @ x.T
    np.fill_diagonal(s, -2)
    wanted = {int(ids[i]): ids[np.argsort(-s[i], kind="stable")[:10]].tolist() for i in range(len(ids))}
    got: dict = {}
    for r in ann.nearest_neighbours(table(spark, SMALL, "embeddings"), block=100, strip=150, tile=32).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append(r.neighbour_id)
    assert got == wanted


def test_asking_rows_meet_all(spark):
    vectors = table(spark, SMALL, "embeddings")
    every = {tuple(r) for r in ann.nearest_neighbours(vectors).collect()}
    some = {tuple(r) for r in ann.nearest_neighbours(vectors, asking="vec_id % 100 = 0", block=2, strip=100).collect()}
    assert some == {r for r in every if r[0] % 100 == 0} and some


@pytest.mark.parametrize("dim", [1040, 1041, 3000])
def test_products_are_exact_at_any_width(dim):
    a = np.full((2, dim), 127, np.int8)
    a[1, ::2] = -127
    assert (ann.products(a, a).astype(np.int64) == a.astype(np.int64) @ a.astype(np.int64).T).all()


def test_quantisation_errors_bound_products():
    random = np.random.default_rng(1)
    x = random.normal(size=(50, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, scale, error = ann.quantise(x)
    about = (codes.astype(np.float64) @ codes.T.astype(np.float64)) * scale[:, None] * scale
    assert (np.abs(about - x @ x.T) <= error[:, None] + (1 + error[:, None]) * error + 1e-12).all()


def test_pipeline_is_its_stages_by_brute_force(spark):
    """Each stage on what the one before kept: rejects go, lines go, one of each group stays, budgets are exact, all tokens are packed."""
    docs = table(spark, SMALL, "documents")
    one = corpus_pipeline.classify(spark, docs, SMALL).cache()
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.99 * sum(labels.values())
    two = corpus_pipeline.drop_lines(spark, one, SMALL).cache()
    pages: dict = {}
    for r in one.collect():
        pages.setdefault(r.source, {})[r.text] = [x.strip(" ") for x in r.text.split("\n")]
    frequent = {s: {x for x, n in Counter(x for p in own.values() for x in set(p) if x).items() if n > 1 and n - 1 > 0.05 * (len(own) - 1)} for s, own in pages.items()}
    wanted = {}
    for r in one.collect():
        lines = [x for x in r.text.split("\n") if x.strip(" ") not in frequent[r.source]]
        if len(lines) == len(r.text.split("\n")) or "\n".join(lines).strip(" "):
            wanted[r.doc_id] = "\n".join(lines)
    assert {r.doc_id: r.text for r in two.collect()} == wanted
    three = corpus_pipeline.drop_near_copies(spark, two, SMALL).cache()
    head = groups({i: b for i, t in wanted.items() if (b := bag(t))}, 0.55)
    left = {r.doc_id for r in three.collect()}
    assert left >= {i for i in wanted if head.get(i, i) == i} and len(left) <= 1.02 * sum(head.get(i, i) == i for i in wanted)
    four = corpus_pipeline.mix(spark, three, SMALL).cache()
    tokens, mixed = Counter(), Counter()
    for r in three.collect():
        tokens[r.source] += len(r.text.split())
    for r in four.collect():
        mixed[r.source] += len(r.text.split())
    weight = {s: n**0.7 for s, n in tokens.items() if n}
    total = max(tokens[s] * sum(weight.values()) / w for s, w in weight.items())
    assert mixed == {s: round(total * w / sum(weight.values())) for s, w in weight.items()}
    assert {r.doc_id for r in four.collect() if r.text.split()} == {r.doc_id for r in three.collect() if r.text.split()}
    five = corpus_pipeline.pack(spark, four, SMALL)
    assert five.agg(F.sum("n_tokens")).first()[0] == sum(mixed.values())


def test_stages_take_odd_tables(spark, tmp_path):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "some words here", None, "a", 3), (4, "word " * 50000, "en", "b", 250000)], kind)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert (docs.count() > 0) == (docs.agg(F.sum("n_tokens")).first()[0] is not None)


def duck(sql: str, sf: str):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    done = con.execute(sql)
    return [d[0] for d in done.description], done.fetchall()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    columns, wanted = duck(oracle_sql()[name], SMALL)
    rows = queries()[name](spark, SMALL).select(*columns).collect()
    plain = lambda r: repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r))
    assert sorted(map(plain, rows)) == sorted(map(plain, wanted))
