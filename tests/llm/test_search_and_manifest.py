"""Nearest neighbours, ranked search and the manifest against brute force, on given tables and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from odd_rows import no_docs, odd_docs  # noqa: F401  fixtures
from pyspark.sql import functions as F

from sensorloom.llm import merkle, neighbours, ranked
from sensorloom.llm.queries import QUERIES


def dot(a, b):
    return float((np.array(a, float) * np.array(b, float)).sum())


def sound(rows):
    """Plain version of the rows that take part."""
    def fits(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    kept = [(i, v) for i, v in rows if i is not None and fits(v)]
    widths = Counter(len(v) for _, v in kept)
    width = max(widths, key=lambda w: (widths[w], w), default=0)
    return {i: v for i, v in kept if len(v) == width}


def nearest(rows, every, k):
    out = []
    for q in rows:
        if q % every == 0:
            order = sorted((-dot(rows[q], v), i) for i, v in rows.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(order)]
    return out


def found(frame):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in frame.collect())


def test_neighbours_of_the_given_table_reach_the_recall(spark):
    rows = sound([(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()])
    got = found(QUERIES["op11_neighbours"](spark, DATA))
    want = nearest(rows, 20, 20)
    assert len(got) == len(want)
    assert len({x[:1] + x[2:3] for x in got} & {x[:1] + x[2:3] for x in want}) >= 0.9 * len(want)
    for q, _, i, score in got:
        assert score == dot(rows[q], rows[i])


@pytest.mark.parametrize("page_rows", [64, 16_384])
def test_neighbours_of_many_rows(spark, page_rows):
    random = np.random.default_rng(5)
    table = [(i, [float(x) for x in random.normal(i % 7, 1 + i % 3, 8).astype(np.float32)]) for i in range(1500)]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>").repartition(5)
    result = neighbours.search(frame, 10, 7, leaf_rows=16, page_rows=page_rows)
    got, want = found(result.neighbours), nearest(dict(table), 10, 7)
    assert len(got) == len(want) and result.rows == 1500
    hits = {x[:1] + x[2:3] for x in got} & {x[:1] + x[2:3] for x in want}
    assert len(hits) >= 0.9 * len(want)


def test_busy_pages_are_copied(spark, monkeypatch):
    random = np.random.default_rng(6)
    table = [(i, [float(x) for x in random.normal(0, 1, 4)]) for i in range(300)]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    plain = found(neighbours.search(frame, 3, 5, recall=1.0).neighbours)
    monkeypatch.setattr(neighbours, "PAGE_VISITS", 20)
    assert found(neighbours.search(frame, 3, 5, recall=1.0).neighbours) == plain


def test_neighbours_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (10, [1.0, 2.0]), (3, [2.0, 1.0]), (4, [-1.0, 0.5]), (20, None), (30, [0.0, 0.0]), (40, [1.0, None]),
            (50, [nan, 1.0]), (60, [inf, 1.0]), (70, [1.0, 2.0, 3.0]), (80, []), (None, [5.0, 5.0]), (7, [3.0, 3.0]), (7, [3.0, 3.0])]
    rows += [(i, [1.0, 2.0]) for i in range(100, 140)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for clash in ("rank", "score", "query_id", "rep", "low", "page", "leaf", "copy"):
        frame = frame.withColumn(clash, F.lit("clash"))
    # ties by smaller id, 42 copies of one vector among them
    assert found(neighbours.search(frame, 10, 3).neighbours) == sorted(nearest(sound(rows), 10, 3))
    # fewer candidates than asked for
    few = spark.createDataFrame([(0, [1.0]), (5, [2.0]), (6, [2.0])], "vec_id long, embedding array<double>")
    assert found(neighbours.search(few, 5, 20).neighbours) == [(0, 1, 5, 2.0), (0, 2, 6, 2.0), (5, 1, 6, 4.0), (5, 2, 0, 2.0)]
    assert found(neighbours.search(frame.limit(0), 10, 3).neighbours) == []
    assert found(neighbours.search(few.filter("vec_id = 6"), 5, 3).neighbours) == []


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranking(docs, items, top):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, df = sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in wanted.items():
        scored = []
        for i, c, n in held:
            m = 10 + 90 * n * len(held) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in own if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, n + 1, x[3], -x[0]) for n, x in enumerate(sorted(scored)[:top])]
    return Counter(out)


def ranked_rows(frame):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect())


@pytest.mark.parametrize("most_items", [3, 1024])
def test_ranked_search_on_odd_rows(spark, odd_docs, no_docs, most_items):
    items = [(1, "Alpha gamma, WORD3 the same"), (2, None), (3, "..."), (4, "ÉTÉ été ñandú 漢字"), (4, "one two"), (None, "row id no"),
             (5, " ".join(f"word{i}" for i in range(200))), (6, "zzz unknown")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert ranked_rows(ranked.search(odd_docs, asked, 4, most_items)) == ranking(docs, items, 4)
    assert ranked_rows(ranked.search(no_docs, asked)) == ranked_rows(ranked.search(odd_docs, asked.limit(0))) == Counter()


def test_masks_are_left_out_only_when_no_document_of_theirs_can_enter(spark):
    random = np.random.default_rng(3)
    docs = [(i, " ".join(f"t{int(x)}" for x in random.zipf(1.5, random.integers(1, 60)) if x < 90)) for i in range(3000)]
    items = [(i, " ".join(f"t{int(x)}" for x in random.integers(1, 90, 25))) for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ranked.search(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert ranked_rows(got) == ranking(docs, items, 10)


def test_few_masks_are_evaluated():
    random = np.random.default_rng(4)
    held = [np.unique(random.integers(0, 40, 12)) for _ in range(4000)]
    starts = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    import pyarrow as pa
    block = ranked.Block(pa.array(range(4000)), np.full(4000, 20), starts, np.concatenate(held), np.ones(starts[-1], np.int64), 40,
                         4000, 80_000)
    best = ranked.Best(10)
    assert block.search(np.arange(8), np.arange(1, 41) * 100, best) < 500 and len(best.ids) == 10


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def steps(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i % 2, level[i ^ 1] if i ^ 1 < len(level) else None))
        i //= 2
    return out


def fold(leaf, path):
    for right, other in path:
        leaf = digest([leaf] if other is None else [other, leaf] if right else [leaf, other])
    return leaf


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_manifest(rows, every):
    groups, out = {}, []
    for r in rows:
        r = {c: r[c] for c in merkle.FIELDS}
        leaf = digest([field(r[c]) for c in merkle.FIELDS])
        changed = None
        if r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % every == 0:
            changed = digest([field(r[c] + 1 if c == "n_chars" else r[c]) for c in merkle.FIELDS])
        groups.setdefault(r["lang"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf), leaf, changed, r["doc_id"]))
    langs = sorted(groups, key=lambda x: b"" if x is None else b"=" + x.encode())
    trees = {x: tree([g[1] for g in sorted(groups[x], key=lambda g: g[0])]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs]) if langs else None
    for k, x in enumerate(langs):
        for i, (_, leaf, changed, doc_id) in enumerate(sorted(groups[x], key=lambda g: g[0])):
            path = steps(trees[x], i) + steps(top, k)
            root = fold(changed or leaf, path)
            out.append((doc_id, leaf, trees[x][-1][0], top[-1][0], digest([s for _, s in path if s]), root, root == top[-1][0]))
    return Counter(out)


def manifest_rows(frame):
    assert frame.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(map(tuple, frame.collect()))


@pytest.mark.parametrize("height", [1, 2, 9])
def test_manifest_on_odd_rows(odd_docs, no_docs, height):
    rows = [r.asDict() for r in odd_docs.collect()]
    assert manifest_rows(merkle.manifest(odd_docs, merkle.tampered_by_crc(2), height)) == plain_manifest(rows, 2)
    assert manifest_rows(merkle.manifest(no_docs, height=height)) == Counter()


@pytest.mark.parametrize("height", [3, 9])
def test_manifest_of_many_rows_and_groups(spark, height):
    rows = [{"doc_id": i, "source": f"s{i % 3}", "lang": None if i % 11 == 0 else "hot" if i % 3 else f"l{i % 37}", "n_chars": i,
             "text": f"text {i}"} for i in range(1300)] + [{"doc_id": 5, "source": "s", "lang": "one", "n_chars": 1, "text": "x"}] * 40
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").repartition(4)
    assert manifest_rows(merkle.manifest(docs, merkle.tampered_by_crc(7), height)) == plain_manifest(rows, 7)


@pytest.mark.parametrize("height", range(8))
def test_layout_is_a_permutation_with_subtrees_together(height):
    at = merkle.addresses(height)
    assert sorted(np.concatenate(at).tolist()) == list(range((2 << height) - 1))
    # every lower subtree of the first split is one stretch
    upper = (height + 1) // 2
    if upper:
        for k in range(1 << upper):
            under = np.concatenate([at[d][k << (d - upper):(k + 1) << (d - upper)] for d in range(upper, height + 1)])
            assert under.max() - under.min() == len(under) - 1
