"""Sharding, line dedup, mixing and quality rules against brute force and on awkward tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SF

from bruit.llm import line_dedup, mixing, quality_rules, sharding
from bruit.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, TEXT2 string, shard string, size string, h string, slot int, n_words int"
LONG = "word " * 30_000
LINE = "This line of more than forty characters stands in many documents"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [(i, f"{LINE}\nown line {i} " + "abc " * 12, "en", "s1") for i in range(12)]
    rows += [(20, None, None, None), (21, "", "en", "s2"), (22, LONG, "de", "s1"), (23, " \n\t ", "en", "s2")]
    rows += [(24, "same text here", "en", "s1")] * 3 + [(None, f"{LINE}\nx", "en", "s1")]
    rows += [(30 + i, "equal texts make a large group", "en", "s3") for i in range(40)]
    return spark.createDataFrame([(*r, 1, "a", "b", "c", "d", 1, 2) for r in rows], DOCS).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def write(spark, df, labels, path):
    df.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    labels.write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def dirs(spark, odd, empty, tmp_path_factory):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    return write(spark, odd, labels, tmp_path_factory.mktemp("odd")), write(spark, empty, labels.limit(0), tmp_path_factory.mktemp("empty"))


def check_shards(rows, n_docs):
    assert len(rows) == n_docs
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < 8
        by[r.shard].append(r)
    for group in by.values():
        assert sorted(r.slot for r in group) == list(range(len(group)))
    return {s: sum(r.size for r in g) for s, g in by.items()}


def test_shards(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = sharding.op1_histogram_shards(spark, SF).collect()
    by = check_shards(rows, len(docs))
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    mean = sum(by.values()) / 8
    assert max(abs(v - mean) for v in by.values()) <= max(r.size for r in rows)


def test_shards_of_odd_tables(spark, odd, dirs):
    rows = sharding.op1_histogram_shards(spark, dirs[0]).collect()
    check_shards(rows, odd.count())
    assert sharding.op1_histogram_shards(spark, dirs[1]).count() == 0


def test_a_large_group_of_equal_texts_is_cut_by_id(spark):
    df = spark.range(4000).selectExpr("7L as h", "id as i", "100L as size")
    got = sharding.shard(df).groupBy("shard").count().collect()
    assert [r["count"] for r in got] == [500] * 8


def test_a_large_group_of_equal_rows_is_cut_by_row_number(spark):
    """4,000 rows share text and id, among 5,000: all shards get their part, and places stay gapless."""
    df = spark.range(5000).selectExpr("if(id < 4000, 7L, id * 1000003) as h", "if(id < 4000, 1L, id) as i", "100L as size")
    rows = sharding.shard(df, sharding.ShardParams(cell_rows=100)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert [len(by[k]) for k in range(8)] == [625] * 8
    last = None
    for k in range(8):
        own = sorted(by[k], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(625))
        order = [(r.h, r.i) for r in own]
        assert order == sorted(order) and (last is None or last <= order[0])
        last = order[-1]


def brute_lines(docs):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))
    seen = defaultdict(set)
    for d, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                seen[k].add(d)
    gone = {k: max(v) for k, v in seen.items() if len(v) >= 5}
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), d) == d]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_line_dedup(spark, dirs):
    for path in (SF, dirs[0]):
        docs = [(r.doc_id, r.text) for r in table(spark, path, "documents").collect() if r.doc_id is not None]
        want = brute_lines(docs)
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.op3_line_dedup(spark, path).collect() if r.doc_id is not None}
        assert got == want
    assert line_dedup.op3_line_dedup(spark, dirs[1]).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, LINE)] * 5 + [(2, LINE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_dropped for r in line_dedup.dedup_lines(df).collect()] == [0] * 6


def test_mix_of_repeated_ids_keeps_its_budget(spark):
    rows = [(1, "w " * 12, "s")] * 10 + [(10 + i, "w " * 9, "s") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = sum(len(r.text.split()) for r in mixing.filter_documents(df).collect())
    assert 156 * 1.5 - 12 < words <= 156 * 1.5


def test_line_stage_keeps_columns_and_documents(odd):
    out = line_dedup.filter_documents(odd)
    assert out.columns == odd.columns
    rows = {r.doc_id: r.text for r in out.collect()}
    assert rows[11].startswith(LINE)
    assert rows[3] == "own line 3 " + "abc " * 12
    assert rows[20] is None


def brute_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    failed = n < 10 or 100 * len(rep) > 20 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), failed


def test_quality_rules(spark, dirs):
    for path in (SF, dirs[0]):
        texts = {(r.doc_id, r.text) for r in table(spark, path, "documents").collect()}
        rows = quality_rules.op10_quality_rules(spark, path).collect()
        got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows}
        assert got == {(d, *brute_counts(t)) for d, t in texts}
        assert not any(r.kept for r in rows if r.base_failed)
    assert quality_rules.op10_quality_rules(spark, dirs[1]).count() == 0


def test_good_documents_are_kept(spark):
    kept = quality_rules.op10_quality_rules(spark, SF).where("kept").select("doc_id")
    good = table(spark, SF, "labels").where("quality = 1").select("doc_id")
    base = quality_rules.op10_quality_rules(spark, SF).where("not base_failed").select("doc_id")
    lost = good.join(base, "doc_id").join(kept, "doc_id", "left_anti").count()
    assert lost <= 0.05 * good.count()


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.3), (3, 20, 0.2), (50, 1000, 0.04), (999, 1000, 0.5), (5, 5, 0.5)])
def test_binomial_cdf(k, n, p):
    from math import comb

    want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert quality_rules.binomial_cdf(k, n, p) == pytest.approx(want, rel=1e-9)


def test_cutoffs_need_enough_labels(spark):
    rows = [(i, "en", False, 0.1, 0.0, 0.0) for i in range(2000)] + [(9000 + i, "xx", False, 0.1, 0.0, 0.0) for i in range(20)]
    counted = spark.createDataFrame(rows, "doc_id long, lang string, base_failed boolean, symbols_per_word double, dup_line_share double, exclaims_per_word double")
    labels = counted.selectExpr("doc_id", "1 as quality")
    cut = quality_rules.calibrate(counted, labels)
    assert cut["en"]["symbols_per_word"] == pytest.approx(0.1)
    assert "xx" not in cut


RULE_COLUMNS = "doc_id long, lang string, base_failed boolean, symbols_per_word double, dup_line_share double, exclaims_per_word double"


@pytest.mark.parametrize("n", [1, 50, 340, 2000, 30_000])
@pytest.mark.parametrize("level", [0.1 / 3, 1e-5])
def test_provable_counts(spark, n, level):
    from pyspark.sql import functions as F

    got = spark.range(1).select(quality_rules._provable(F.lit(n).cast("long"), 0.05 / 3, level)).first()[0]
    k = -1
    while quality_rules.binomial_cdf(k + 1, n, 0.05 / 3) <= level:
        k += 1
    assert got == k


def test_strata_have_no_cap(spark):
    n = 70  # strata with labels, and one without
    rows = [(s * 1000 + i, f"l{s:02d}", False, 0.1, 0.0, 0.0) for s in range(n) for i in range(800)]
    rows += [(s * 1000 + 900 + i, f"l{s:02d}", False, 0.8, 0.0, 0.0) for s in range(n) for i in range(5)]
    new = [(10**6 + i, "new", False, 2.9, 0.9, 2.9) for i in range(3)]
    held = spark.createDataFrame(rows, RULE_COLUMNS)
    labels = held.selectExpr("doc_id", "int(doc_id % 1000 < 900) as quality")
    counted = held.unionByName(spark.createDataFrame(new, RULE_COLUMNS))
    cuts = quality_rules.cutoffs(counted, labels)
    assert {(r.lang, r.step) for r in cuts.where("rule = 0").collect()} == {(f"l{s:02d}", 15) for s in range(n)}
    kept = {r.doc_id: r.kept for r in quality_rules.verdict(counted, cuts).collect()}
    assert len(kept) == len(rows) + 3
    assert all(v == (k >= 10**6 or k % 1000 < 900) for k, v in kept.items())


def test_cutoffs_reject_bad_documents_not_good_ones(spark):
    rows = [(i, "en", False, 0.1, 0.0 if i >= 20 else 0.5, 0.0) for i in range(4000)]
    rows += [(5000 + i, "en", False, 0.1 + 0.5 * (i < 50), 0.5 * (i < 5), 0.0) for i in range(100)]
    counted = spark.createDataFrame(rows, RULE_COLUMNS)
    cut = quality_rules.calibrate(counted, counted.selectExpr("doc_id", "int(doc_id < 5000) as quality"))["en"]
    assert cut["symbols_per_word"] == pytest.approx(0.55)  # all fifty bad ones, and nothing below
    assert cut.get("dup_line_share", 1.0) >= 0.5  # twenty good ones for five bad ones


def test_repeated_rows_prove_nothing(spark):
    """Thirty good documents are thirty draws, however often their rows are repeated."""
    rows = [(i, "en", False, 0.1, 0.0, 0.0) for i in range(30) for _ in range(100)] + [(100 + i, "en", False, 2.0, 0.9, 2.0) for i in range(5)]
    counted = spark.createDataFrame(rows, RULE_COLUMNS)
    labels = counted.selectExpr("doc_id", "int(doc_id < 30) as quality")
    assert quality_rules.cutoffs(counted, labels).count() == 0


def test_mix(spark, dirs):
    for path in (SF, dirs[0]):
        rows = mixing.op6_source_mix(spark, path).collect()
        docs = table(spark, path, "documents").collect()
        assert len(rows) == len(docs)
        total = sum(r.size for r in rows)
        assert total == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs)
        assert sum(r.taken for r in rows) <= 1.5 * total
        source = {r.doc_id: r.source for r in docs}
        taken, target, longest = Counter(), {}, Counter()
        for r in rows:
            assert r.taken <= 2 * r.size
            s = source[r.doc_id]
            taken[s] += r.taken
            target[s] = r.target
            longest[s] = max(longest[s], r.size)
        assert sum(target.values()) == pytest.approx(1.5 * total)
        for s, v in target.items():
            assert v - longest[s] - 1 <= taken[s] <= v + longest[s] + 1
        again = mixing.op6_source_mix(spark, path).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert mixing.op6_source_mix(spark, dirs[1]).count() == 0


def test_mix_stage_keeps_columns(odd):
    assert mixing.filter_documents(odd).columns == odd.columns
