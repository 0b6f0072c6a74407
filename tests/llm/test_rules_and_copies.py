"""Line rules, exact copies and near copies against brute force, on given tables and on odd rows."""

import collections
import hashlib
import re
import tracemalloc

import duckdb
import numpy as np
import pytest
import xxhash
from conftest import DATA
from odd_rows import no_docs, odd_docs  # noqa: F401  fixtures
from oracle import connect, differences

from sensorloom.llm import content_sort, line_rules, simhash
from sensorloom.llm.components import components
from sensorloom.llm.queries import ORACLES, QUERIES, line_rules_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, DATA), connect(DATA), ORACLES[name]) == []


@pytest.mark.parametrize("least", [2, 5, 30])
def test_line_rule_equals_its_sql_where_it_rejects(spark, docs, least):
    """The given table and documents that share 17 of their 20 lines, some of them near copies."""
    rng = np.random.default_rng(11)

    def line():
        return " ".join(f"w{int(k)}" for k in rng.integers(0, 4000, 9))
    shared = [line() for _ in range(17)]
    rows = [(10**6 + i, "\n".join([*shared, *[line() for _ in range(3)]]), "site") for i in range(120)]
    copied = [line() for _ in range(20)]
    rows += [(2 * 10**6 + i, "\n".join([*copied[:-1], copied[-1] + (f" {i}" if i % 40 == 0 else "")]), "copies") for i in range(80)]
    rows += [(3 * 10**6 + i, text, source) for i, (text, source) in enumerate([(None, "site"), ("", None), ("one\n\ntwo", "site")])]
    table = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = line_rules.judged(table, least).drop("key", "removed_words")
    con = duckdb.connect()
    given = table.toPandas()
    con.register("documents", given)
    assert differences(found, con, line_rules_sql(least)) == []
    verdicts = {r["doc_id"]: r["kept"] for r in found.filter("doc_id >= 1000000 and doc_id < 3000000").collect()}
    assert not any(kept for i, kept in verdicts.items() if i < 2 * 10**6)
    assert least < 30 or all(kept for i, kept in verdicts.items() if i >= 2 * 10**6)


def rows_of(frame):
    return [r.asDict() for r in frame.collect()]


def best_of(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append(r)
    return {n: (min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))["doc_id"], len(g))
            for n, g in groups.items()}


@pytest.mark.parametrize("slice_rows", [2, 20_000])
def test_content_sort_on_odd_rows(odd_docs, slice_rows):
    given = rows_of(odd_docs)
    best = best_of(given)
    found = rows_of(content_sort.exact_duplicates(odd_docs, slice_rows))
    assert len(found) == len(given)
    want = collections.Counter()
    for r in given:
        n = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        want[r["doc_id"], best[n][0], best[n][1], hashlib.sha256(n.encode()).hexdigest()] += 1
    assert want == collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found)
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len(best) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_stages_keep_columns_and_take_empty_tables(odd_docs, no_docs):
    for stage in (content_sort.without_copies, simhash.one_of_each, line_rules.passing):
        assert stage(no_docs).columns == odd_docs.columns and stage(no_docs).count() == 0
    assert content_sort.without_copies(odd_docs).columns == odd_docs.columns
    assert content_sort.without_copies(odd_docs).count() == len(best_of(rows_of(odd_docs)))


def test_partitioned_by_range_without_a_second_exchange(docs):
    plan = content_sort.exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan


def stats(text):
    words = WORD.findall(text or "")
    grams = list(zip(words, words[1:], words[2:], strict=False))
    twice = collections.Counter(grams)
    spots = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(spots))


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_line_rules_on_odd_rows(odd_docs):
    want = collections.Counter((r["doc_id"], *stats(r["text"])) for r in rows_of(odd_docs))
    found = rows_of(line_rules.judged(odd_docs))
    assert want == collections.Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in found)
    for r in found:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and (not failed or not r["kept"])


def test_common_lines_count_documents_of_a_host_and_copies_once(spark):
    def body(i):
        return " ".join(f"own{i}w{k}" for k in range(60))
    line = "This line is on every page of the host and says nothing " * 4
    rows = [(i, f"{line}\n{body(i)}", "h") for i in range(40)]
    rows += [(100 + i, f"{line}\nfew words {i}", "h") for i in range(5)]  # little is left without the line
    rows += [(200 + i, f"{line} and only copies of one page have it {'yes ' * 3}\n" + body(7), "other") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdict = {r["doc_id"]: r["kept"] for r in line_rules.judged(docs, least=20, share=0.1).collect()}
    assert all(verdict[i] for i in range(40)) and not any(verdict[100 + i] for i in range(5))
    assert all(verdict[200 + i] for i in range(60))
    left = {r["doc_id"]: r["text"] for r in line_rules.without_common_lines(docs, 20, 0.1).collect()}
    assert left[3] == body(3) and left[100] == "few words 0" and left[200] == rows[-1][1]
    assert sorted(r["doc_id"] for r in line_rules.passing(docs, least=20, share=0.1).collect()) == sorted(
        d for d, keep in verdict.items() if keep)


@pytest.mark.parametrize("shared", [80, 90, 95])
def test_lines_shared_by_most_of_a_text_are_counted_by_document(spark, shared):
    def lines(name, n):
        return [" ".join(f"{name}{k}x{j}" for j in range(10)) for k in range(n)]
    block = lines(f"block{shared}", shared // 5)
    rows = [(i, "\n".join(block + lines(f"own{i}", 20 - len(block))), "h") for i in range(300)]
    rows += [(1000 + i, "\n".join(lines(f"page{i}", 20)), "h") for i in range(300)]
    rows += [(2000 + i, "\n".join(lines("copied", 20)), "h") for i in range(300)]  # copies of one page count once
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in line_rules.judged(docs).collect() if r["kept"]}
    assert kept == {i for i, _, _ in rows if i >= 1000}


def fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_query_against_brute_force(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {i: fingerprint(t) for i, t in texts.items()}
    pairs = [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 2]
    want = closure(pairs, marks)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op4_simhash"](spark, DATA).collect()}
    assert found == {i: (f"{m:016x}", want[i]) for i, m in marks.items()}


def test_simhash_on_odd_rows(odd_docs, no_docs):
    given = rows_of(odd_docs)
    found = rows_of(simhash.near_duplicates(odd_docs))
    assert collections.Counter((r["doc_id"], fingerprint(r["text"])) for r in given) == collections.Counter(
        (r["doc_id"], r["fingerprint"] % (1 << 64)) for r in found)
    assert {r["component_id"] for r in found if r["fingerprint"] == 0} == {3}
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize(("radius", "parts", "tile"), [(2, 1, 8), (2, 4, 100), (2, 8, 3), (9, 1, 16)])
def test_links_connect_what_brute_force_connects(spark, radius, parts, tile):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (1, 2, 3, 8)]
    values = sorted({v - (1 << 64) if v >= 1 << 63 else v for v in [*map(int, base), *near]})
    distinct = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    edges = [(r["a"], r["b"]) for r in simhash.links(distinct, radius, tile, parts).collect()]
    real = [(a, b) for a in values for b in values if a < b and ((a ^ b) % (1 << 64)).bit_count() <= radius]
    assert closure(edges, values) == closure(real, values)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(300, 200), (300, 301), (5, 5)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert found == {n: c for n, c in closure(edges, nodes).items()}


def test_one_document_of_each_group_stays(spark):
    rng = np.random.default_rng(3)
    base = [f"w{int(k)}" for k in rng.integers(0, 5000, 900)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (None, " ".join(base)), (None, "quite another text of its own")]
    for i in range(30):  # some stay within two bits, some do not
        rows.append((10 + i, " ".join([*base[:-1 - i % 4], f"new{i}"])))
    rows += [(200 + i, " ".join(f"w{int(k)}" for k in rng.integers(0, 5000, 40))) for i in range(20)]
    marks = [fingerprint(t) for _, t in rows]
    real = [(a, b) for a in range(len(rows)) for b in range(a) if (marks[a] ^ marks[b]).bit_count() <= simhash.RADIUS]
    groups = collections.defaultdict(list)
    for i, c in closure(real, range(len(rows))).items():
        groups[c].append(rows[i][0])
    want = [min((x for x in g if x is not None), default=None) for g in groups.values()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r["doc_id"] for r in simhash.one_of_each(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, want)) and 22 <= len(kept) < len(rows) - 10


def test_a_crowd_within_the_radius_is_folded_by_block():
    singles = np.array([0] + [1 << k for k in range(60)], np.uint64)
    crowd = np.unique((singles[:, None] | singles[None, :]).ravel())  # all within 2 bits of 0, 4 of each other
    tracemalloc.start()
    x, y = simhash.folded(crowd, crowd, simhash.linked_blocks(crowd, crowd, 2, 1 << 14))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(x) == len(crowd) - 1 and set(y.tolist()) == {0} and peak < 64 << 20


def test_near_copies_are_dropped_by_the_few_that_go(spark, monkeypatch):
    rows = [(i, f"text{i} with some words{i * 7} of its own{i * 13}") for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(None, rows[0][1]), (None, "only here"), (None, "only here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sides, join = [], simhash.lookup
    monkeypatch.setattr(simhash, "lookup", lambda left, side, on, *a: sides.append((on, side.count())) or join(left, side, on, *a))
    got = simhash.one_of_each(docs).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in docs.collect()
                                           if (r["doc_id"] or 0) < 100 and (r["doc_id"] is not None or r["text"] == "only here"))
    assert [n for on, n in sides if on == ["key"]] == [6]
