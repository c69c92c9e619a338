"""Sharding, personal data and quality rules: expressions only."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import connection, of_spark, of_sql
from pyspark.sql import functions as F
from test_growth import most_rows

from medloom.llm import pii, quality, queries, shard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, small, name):
    assert of_spark(queries.QUERIES[name](spark, small)) == of_sql(connection(small), queries.ORACLES[name])


# --- sharding -------------------------------------------------------------------------------------------------------


def slots(df, n):
    got = Counter((r.shard, r.slot) for r in df.select("shard", "slot").collect())
    sizes = Counter(s for s, _ in got)
    assert max(got.values()) == 1
    assert all({slot for s, slot in got if s == shard_} == set(range(size)) for shard_, size in sizes.items())
    assert max(sizes.values()) - min([*sizes.values(), *[0] * (n > len(sizes))]) <= 1
    return sizes


def test_shards_are_gapless_and_even(spark, small):
    rows = queries.op1_shard(spark, small)
    assert sum(slots(rows, 24).values()) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert rows.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    assert all((r["size"], r.text_crc32) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id])) for r in rows.collect())


def test_shards_of_odd_rows(odd, empty, odd_rows):
    out = shard.shard_uniform(odd, 4, block_rows=2)
    assert sum(slots(out, 4).values()) == len(odd_rows)
    key = lambda rows: Counter(tuple(r)[:5] for r in rows)
    assert key(out.collect()) == key(odd.collect())
    names = ["_key", "_first", "_at", "_block", "_rank", "_n", "_start", "_pid", "_pos", "row"]
    more = shard.shard_uniform(odd.withColumns({c: F.lit(c) for c in names}), 4)
    assert all(r[c] == c for r in more.collect() for c in names)
    assert shard.shard_uniform(empty, 4).count() == 0
    with pytest.raises(ValueError, match="slot"):
        shard.shard_uniform(odd.withColumn("slot", F.lit(1)), 4)


def test_matrix_margins_through_levels(spark):
    counts = spark.range(200).select(F.col("id").alias("pid"), (F.col("id") % 37 + 1).alias("n"))
    rows = shard.communication_matrix(counts, 7, 3).collect()
    deal = np.array([r.deal for r in rows])
    assert (deal.sum(1) == [r.n for r in rows]).all()
    assert deal.sum(0).max() - deal.sum(0).min() <= 1


def test_hypergeometric_law(spark):
    draws = spark.range(20_000).select(
        F.expr(shard.hypergeometric("30", "70", "20", "shiftrightunsigned(xxhash64(id), 11) * 1.1102230246251565E-16D")).alias("x"))
    got = np.array([r.x for r in draws.collect()])
    assert abs(got.mean() - 6) < 0.1
    assert abs(got.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.15


# --- quality --------------------------------------------------------------------------------------------------------


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, odd, odd_rows, docs, texts):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = Counter((r.doc_id, *[r[c] for c in cols]) for r in quality.measured(odd).collect())
    assert got == Counter((i, *measures(t)) for i, t, *_ in odd_rows)
    assert {r.doc_id: tuple(r[c] for c in cols) for r in quality.measured(docs).collect()} == {i: measures(t) for i, t in texts.items()}
    repeated = spark.createDataFrame([(1, "a b c d e " * 6 + "x"), (2, "q a b c d e q a b c d e f")], "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in quality.measured(repeated).collect()} == {i: measures(t)[4] for i, t in repeated.collect()}


def test_policies_and_ablations(odd, empty):
    rows = quality.ledger(odd, keep=("source",))
    assert "source" in rows.columns
    table = {r.rule: r for r in quality.ablations(rows, "prose@1").collect()}
    masks = [r.fail_mask for r in rows.collect()]
    mask = quality.policy_mask("prose@1")
    for rule in quality.RULES:
        bit = 1 << rule.bit
        assert table[rule.name].failed == sum(bool(m & bit) for m in masks)
        assert table[rule.name].failed_alone == sum(m & mask == bit for m in masks)
        assert table[rule.name].kept_without == sum(m & mask & ~bit == 0 for m in masks)
    assert quality.ledger(empty).count() == 0
    with pytest.raises(ValueError, match="n_words"):
        quality.ledger(odd.withColumnRenamed("lang", "n_words"), keep=("n_words",))


def test_clean_documents_stay(spark, small):
    rows = queries.op10_quality(spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").where("quality = 1 and not base_failed")
    assert rows.where("not kept").count() == 0


# --- personal data --------------------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = [
    "mail a.b@c.de, x@y.z.w. é@é a@b", "1.2.3.4 256.1.1.1 1.2.3.4.5 00001.2.3.4 999999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111", "+1 (555) 010-9999 and +12 +123456789 ++1234567890",
    "é4111111111111111é +49 30 1234567", "a@b.c@d.e _x@d.e", "",
]


def test_base_spans(spark, docs, texts):
    df = spark.createDataFrame([*enumerate(TRICKY), (99, None)], "doc_id long, text string")
    got = {r.doc_id: [(pii.KINDS[s.kind], s.start, s.end) for s in r.base] for r in pii.base_spans(df).collect()}
    assert got == {i: base_spans(t) for i, t in [*enumerate(TRICKY), (99, None)]}
    found = {r.doc_id: r for r in pii.find_personal(docs.select("doc_id", "text")).collect()}
    assert {i: [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans if s.base] for i, r in found.items()} == {i: base_spans(t) for i, t in texts.items()}


def test_digest(spark, small, texts):
    for r in queries.op7_pii(spark, small).collect():
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()


def test_patterns_discover_and_spare(spark):
    rows = [(i, f"please call me +1 (555) 010-{1000 + i} thanks. call me 555-010-{7000 + i} now, order 555-010-{8000 + i}") for i in range(12)]
    found = pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        assert [r.text[s.start : s.end] for s in r.spans] == [f"+1 (555) 010-{1000 + r.doc_id}", f"555-010-{7000 + r.doc_id}"]


def test_strong_discoveries_stay(spark):
    """Three patterns near certainty bring the score of an unseen value to 1.0 in a double; it is still no seed."""
    rows = [f"please {c} +1 (555) 010-{1000 + 100 * k + i} thanks" for k, c in enumerate(("call me", "ring us", "phone at")) for i in range(19)]
    rows += [f"please {c} 555-010-7000 thanks" for c in ("call me", "ring us", "phone at")]
    found = pii.find_personal(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")).collect()
    assert [[r.text[s.start : s.end] for s in r.spans] for r in found if "7000" in r.text] == [["555-010-7000"]] * 3


def discoveries(spark, texts):
    rows = pii.find_personal(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    return {r.text[s.start : s.end] for r in rows for s in r.spans if not s.base}


def test_spans_end_inside_their_text(spark):
    rows = [f"please call me +1 (555) 010-{1000 + i} thanks" for i in range(12)] + ["please call me 030 1234 567 890", "desk 030 1234 567 890", "please call me 555 010-7000", "desk 555 010-7000"]
    found = pii.find_personal(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")).collect()
    ends = {r.doc_id: [(s.start, s.end) for s in r.spans if not s.base] for r in found}
    assert [ends[k] for k in (12, 13, 14, 15)] == [[(15, 31)], [(5, 21)], [(15, 27)], [(5, 17)]]


def test_only_contexts_become_rows(spark, monkeypatch):
    docs = spark.createDataFrame([("it is said that you may call me 7 times or " * 50,)] * 40, "text string")
    contexts = spark.createDataFrame([("call me",), ("never met",)], "context string")
    rows, most = most_rows(pii._totals(pii.base_spans(docs), "text", contexts))
    assert [tuple(r) for r in rows] == [("call me", 2000)] and most <= 2000
    monkeypatch.setattr(pii, "FEW", 1)
    assert [tuple(r) for r in pii._totals(pii.base_spans(docs), "text", contexts).collect()] == [("call me", 2000)]


def test_contexts_count_in_all_documents(spark):
    rows = [f"please call me +1 (555) 010-{1000 + i} thanks" for i in range(12)] + ["please call me 555-010-7000 thanks"]
    assert discoveries(spark, rows) == {"555-010-7000"}
    assert discoveries(spark, rows + ["they call me often"] * 60) == set()


def test_numbers_written_as_words(spark):
    cards = [f"411111111111{i:04d}" for i in range(400)]
    cards = [" ".join(c[k : k + 4] for k in (0, 4, 8, 12)) for c in cards if luhn(c)][:20]
    rows = [f"please call me +1 (555) 010-{1000 + i} thanks" for i in range(20)] + [f"my card: {c} thanks" for c in cards]
    rows += ["please call me (555) 123-4567 now", "please call me 030 1234 5678, or write", "my card: 4111 1111 1111 1112 is void", "desk 030\n1234  5678."]
    assert discoveries(spark, rows) == {"(555) 123-4567", "030 1234 5678", "030\n1234  5678", "4111 1111 1111 1112"}


def test_rounds_go_on_until_nothing_new_comes(spark):
    number = lambda level, i: f"555-{level}10-{7000 + i}"
    rows = [f"in step0 +1 (555) 010-{1000 + i} thanks" for i in range(30)] + [f"in step0 {number(0, i)} thanks" for i in range(3)]
    for level in range(5):
        rows += [f"in step{level + 1} {number(level, i)} thanks" for i in range(3)] * 2 + [f"in step{level + 1} {number(level + 1, i)} thanks" for i in range(3)]
    assert discoveries(spark, rows) == {number(level, i) for level in range(6) for i in range(3)}


def test_long_runs_and_clashing_columns(spark):
    numbers = " ".join(f"1.2.3.{i % 256}" for i in range(3000))
    texts = ["1" * 1_000_000, "a@b" + ".c" * 100_000, "1.1" * 4000, "-" * 1_000_000 + "x", "a" * 1_000_000 + " q@r.st", numbers, "a@b.c._x@d.e", "1 " * 20_000]
    rows = [(i, t, i, i, i, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, more int, base int, _key int, key int")
    found = {r.doc_id: r for r in pii.find_personal(df).collect()}
    assert all((r.more, r.base, r["_key"], r.key) == (i, i, i, i) for i, r in found.items())
    got = {i: [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans] for i, r in found.items()}
    assert got[1] == [("email", 0, len(texts[1]))]
    assert (got[0], got[3], got[7]) == ([], [], [])
    assert got[2] == base_spans(texts[2])
    assert got[4] == [("email", 1_000_001, 1_000_007)]
    assert got[5] == base_spans(numbers) and len(got[5]) == 3000
    assert got[6] == base_spans(texts[6])


def test_found_values_are_quoted(spark):
    odd = r"(555\E(010"
    known = spark.createDataFrame([(odd, 3)], "value string, kind int")
    rows = spark.createDataFrame([(1, f"x {odd} y {odd}."), (2, "none 5")], "key long, text string")
    assert sorted((r.key, r.kind, r.start, r.end) for r in pii._found(rows, known).collect()) == [(1, 3, 2, 12), (1, 3, 15, 25)]


def test_spans_are_kept_apart_by_sweeps(spark):
    rng = random.Random(12)
    span = lambda: (rng.randrange(60), rng.randint(1, 12))
    base = sorted({(k, s, s + n) for k in (1, 2) for s, n in (span() for _ in range(4))})
    found = sorted({(k, rng.randrange(3), s, s + n) for k in (1, 2, 3) for s, n in (span() for _ in range(40))})
    free = [f for f in found if not any(b[0] == f[0] and b[1] < f[3] and f[2] < b[2] for b in base)]
    want = [f for f in free if not any(o[:2] == f[:2] and o[2] <= f[2] and f[3] <= o[3] and o != f for o in free)]
    rows = pii._apart(spark.createDataFrame(found, "key long, kind int, start int, end int"), spark.createDataFrame(base, "key long, start int, end int")).collect()
    assert sorted((r.key, r.kind, r.start, r.end) for r in rows) == want and 10 < len(want) < len(found)


def test_redaction_of_overlaps(spark):
    rng = random.Random(13)
    texts = {i: "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 3000))) for i in range(12)}
    spans = {i: [(rng.randrange(4), s, min(len(t), s + rng.randint(1, 9)), True) for s in (rng.randrange(len(t)) for _ in range(rng.choice([0, 3, 700])))] if t else [] for i, t in texts.items()}
    df = spark.createDataFrame([(i, t, spans[i]) for i, t in texts.items()], "doc_id int, text string, spans array<struct<kind:int,start:int,end:int,base:boolean>>")
    for r in pii.redact(df).collect():
        out, at, t = "", 0, texts[r.doc_id]
        order = sorted((s, e, k) for k, s, e, _ in spans[r.doc_id])
        while order:
            s, e, k = order.pop(0)
            while order and order[0][0] < e:
                e = max(e, order.pop(0)[1])
            out, at = out + t[at:s] + f"[{pii.KINDS[k].upper()}]", e
        assert r.text == out + t[at:]


def test_thousands_of_identifiers_in_one_text(spark):
    n = 3000
    text = " ".join(f"mail to a{i}[at]b.com, mail to a{i}@b.com" for i in range(n))
    row = pii.redact(pii.find_personal(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert len(row.spans) == 2 * n and row.text == " ".join(["mail to [EMAIL], mail to [EMAIL]"] * n)
    assert [(s.start, s.end) for s in row.spans if not s.base] == [(m.start(), m.end()) for m in re.finditer(r"a[0-9]+\[at\]b\.com", text)]


def test_redaction_and_odd_rows(spark, odd, empty, odd_rows):
    df = spark.createDataFrame([(1, "to a@b.cd from 1.2.3.4!"), (2, None), (3, "plain")], "doc_id long, text string")
    rows = pii.redact(pii.find_personal(df)).collect()
    assert {r.doc_id: r.text for r in rows} == {1: "to [EMAIL] from [IP]!", 2: None, 3: "plain"}
    assert pii.find_personal(odd).count() == len(odd_rows)
    assert pii.find_personal(empty).count() == 0
    with pytest.raises(ValueError, match="spans"):
        pii.find_personal(odd.withColumn("spans", F.lit(1)))
