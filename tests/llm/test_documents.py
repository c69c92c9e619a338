"""Near copies, passages, languages, mixing, packing and archives against plain versions of themselves."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import words  # tests/llm/conftest.py
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from medloom.llm import cc, jaccard, langid, mix, pack, passages, queries, warc
from medloom.llm.shingles import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(texts):
    """{key: (set size, smallest key reachable)} by comparing all pairs that share a shingle."""
    shingle_sets = {k: sets(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in sorted(shingle_sets.items()):
        common = Counter(o for g in s for o in holders[g])
        for o, n in common.items():
            if 100 * n >= 75 * (len(s) + len(shingle_sets[o]) - n):
                a, b = find(k), find(o)
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(k)
    return {k: (len(s), find(k)) for k, s in shingle_sets.items()}


# --- near copies ----------------------------------------------------------------------------------------------------


def test_groups_match_all_pairs(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs).collect()}
    assert got == groups(texts)


def test_large_family_with_many_edits(spark):
    rng = random.Random(5)
    base = words(rng, 120).split()
    texts = {}
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(40)}"
        texts[i] = " ".join(w)
    texts |= {1000 + i: " ".join([*base[:40], *words(rng, 90).split()]) for i in range(60)}
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(df).collect()} == groups(texts)


@pytest.mark.parametrize("rows", [10**6, 0])
def test_hot_keys_are_cut_up_without_losing_links(spark, rows):
    """Pages of one template with 10 to 24 % of their own text, all keys hot, frequent shingles broadcast and joined."""
    rng = random.Random(6)
    template = words(rng, 150).split()
    texts = {i: " ".join([*template, *words(rng, rng.randint(10, 48)).split()]) for i in range(70)}
    texts |= {100 + i: words(rng, 3) + " " + " ".join(template) for i in range(5)} | {200: texts[3], 201: texts[3].upper()}
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    limits = jaccard.Limits(frequent=4, frequent_rows=rows, salt_rows=8, tile=8, light=0 if rows else 20)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(df, limits=limits).collect()} == groups(texts)


def test_pair_of_many_keys_is_found_once(spark):
    """Under the smallest common key only, in whatever task the others are; unlike sets go where they meet."""
    rng = np.random.default_rng(9)
    a = np.unique(rng.integers(0, 2**64, 200, dtype=np.uint64))
    sets = [a, np.unique(np.append(a[5:], rng.integers(0, 2**64, 5, dtype=np.uint64))), np.unique(rng.integers(0, 2**64, 200, dtype=np.uint64))]
    nodes = spark.createDataFrame([(i, len(x), bytearray(jaccard.bitmap(x)), i) for i, x in enumerate(sets)], "node long, n long, bits binary, mark long")
    rows = spark.createDataFrame([(key, i, len(x), i) for key in range(10) for i, x in enumerate(sets)], "key long, node long, n long, root long")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert [tuple(r) for r in jaccard._tile_pairs(rows, nodes, None, 1024, 64).collect()] == [(0, 1)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_few_words_go_through_the_tokenizer_at_a_time():
    table, most = pack.TokenTable(public_tokenizers.path("word_bpe_49k.json")), []

    class Seen:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode(self, text, **options):
            most.append(len(text.split()))
            return self.tokenizer.encode(text, **options)

        def encode_batch(self, texts, **options):
            most.append(len(texts))
            return self.tokenizer.encode_batch(texts, **options)

    rng, plain = random.Random(8), table.tokenizer
    table.tokenizer = Seen(plain)
    text = " ".join(f"{words(rng, 1)}{'abcdefghij'[i % 10]}{'' if i % 3 else i}" for i in range(30_000))
    rows = table.rows(text.encode())
    table.learn()
    assert table.encoded(rows).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(table) > 5000 and max(most) <= 2048


def test_packed_numbers():
    x = np.random.default_rng(3).integers(0, 2**32, 1000, dtype=np.uint32)
    assert (jaccard._numbers(jaccard._planes(x)) == x).all()


def test_bitmaps_never_exclude_a_link():
    rng = np.random.default_rng(4)
    for n in (1, 5, 300, 20_000):
        pool = rng.integers(0, 2**64, 2 * n + 4, dtype=np.uint64)
        a = np.unique(pool[:n])
        b = np.unique(np.concatenate([pool[: n - n // 9], pool[n : n + n // 7]]))
        p, q = (np.frombuffer(jaccard.bitmap(x), np.uint8)[None, :] for x in (a, b))
        width = min(p.shape[1], q.shape[1])
        differ = int(np.bitwise_count(jaccard.folded(p, width) ^ jaccard.folded(q, width)).sum())
        assert (len(a) + len(b) - differ) // 2 >= len(np.intersect1d(a, b))


def test_odd_rows(odd, empty, odd_rows):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(odd).collect())
    assert got[1, 76, 1] == 1 and got[2, 76, 1] == 2 and got[3, 0, 3] == 1 and got[4, 0, 4] == 1 and got[8, 1, 8] == 1
    assert sum(got.values()) == len(odd_rows)
    assert jaccard.similar_groups(empty).count() == 0


def test_one_row_of_near_copies_stays(spark, odd, empty, odd_rows):
    rng = random.Random(7)
    base = words(rng, 120)
    near = lambda n: base + " " + words(rng, n)
    lone = words(rng, 50)
    rows = [(i, text, "en", "a", 1) for i, text in [(3, near(2)), (3, base.upper()), (1, near(1)), (1, base), (None, base), (None, base), (None, near(3)), (None, lone), (None, lone), (None, lone.upper()), (4, ""), (4, ""), (None, None), (None, None)]]
    rows.append((None, base, None, "en", 1))
    df = spark.createDataFrame(rows, odd.schema)
    got = [tuple(r)[:2] for r in corpus_pipeline.keep_one_of_near_copies(spark, df, "").collect()]
    assert sorted(map(str, [r for r in got if not r[1]])) == sorted(map(str, [(4, ""), (4, ""), (None, None), (None, None)]))
    some = sorted([r for r in got if r[1]], key=str)
    assert [i for i, _ in some] == [1, None]
    assert some[1][1].lower() == lone
    assert Counter(tuple(r)[0] for r in corpus_pipeline.keep_one_of_near_copies(spark, odd, "").collect()) == Counter([1, 3, 4, None, 5, 6, 7, 8, 8])
    assert corpus_pipeline.keep_one_of_near_copies(spark, empty, "").count() == 0



def test_components_of_a_path_a_star_and_nothing(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(200, 260)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100} | {i: 100 for i in range(200, 260)}
    assert cc.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- passages -------------------------------------------------------------------------------------------------------


def test_pasted_passages_are_found_wherever_they_stand(spark):
    rng = random.Random(9)
    passage, short = words(rng, 51), words(rng, 42)
    texts = {i: words(rng, 150).split(" ") for i in range(30)}
    for i, at in ((3, 0), (8, 20), (21, 150)):
        texts[i][at:at] = passage.split(" ")
    for i in (4, 9):
        texts[i][30:30] = short.split(" ")
    joined = {i: " ".join(w) for i, w in texts.items()}
    out = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(sorted(joined.items()), "doc_id long, text string")).collect()}
    assert {i for i, r in out.items() if r.removed_chars} == {8, 21}
    assert {i for i, r in out.items() if r.n_repeated} == {3, 8, 21}
    for i in (8, 21):
        assert out[i].kept_in == [3]
        a, b = map(int, out[i].spans.split(":"))
        assert len(joined[i][a:b].split()) >= passages.SPAN and joined[i][a:b] in passage


def test_near_copied_paragraphs(spark):
    rng = random.Random(10)
    line = words(rng, 70).split()
    edited = [*line[:34], "édité", *line[35:]]
    rows = [(1, "x\n" + " ".join(line)), (2, words(rng, 60) + "\n" + " ".join(edited) + "\nend"), (3, words(rng, 90))]
    out = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b = map(int, out[2].spans.split(":"))
    assert rows[1][1][a:b] == " ".join(edited)
    assert (out[1].removed_chars, out[3].n_repeated) == (0, 0)


def lines_of(text):
    return [w for line in (text or "").split("\n") if len(w := WORD.findall(line.translate(LOWER))) >= passages.LEAST_WORDS]


@pytest.mark.parametrize("limits", [jaccard.LIMITS, jaccard.Limits(frequent=3, salt_rows=8, tile=8), jaccard.Limits(frequent=3, frequent_rows=0)])
def test_repeats_match_all_pairs(docs, texts, limits):
    got = {r.doc_id: r for r in passages.repeated_passages(docs, limits=limits).collect()}
    joined = {" ".join(w): w for t in texts.values() for w in lines_of(t)}
    root = {k: v[1] for k, v in groups({k: k for k in joined}).items()}
    holders, sequences = defaultdict(set), defaultdict(set)
    for i, t in texts.items():
        for w in lines_of(t):
            holders[root[" ".join(w)]].add(i)
        w = WORD.findall((t or "").translate(LOWER))
        for n in (passages.SPAN, passages.SPAN + passages.WINDOW - 1):
            for at in range(len(w) - n + 1):
                sequences[tuple(w[at : at + n])].add(i)
    missed = total = 0
    for i, t in texts.items():
        long = sum(len(holders[root[" ".join(w)]]) > 1 for w in lines_of(t) if len(w) >= passages.LONG)
        short = sum(len(holders[root[" ".join(w)]]) > 1 for w in lines_of(t) if len(w) < passages.LONG)
        w = WORD.findall((t or "").translate(LOWER))
        shares = lambda n: any(len(sequences[tuple(w[at : at + n])]) > 1 for at in range(len(w) - n + 1))  # noqa: E731, B023
        assert got[i].n_short <= short
        missed += short - got[i].n_short
        total += short
        assert not shares(passages.SPAN + passages.WINDOW - 1) or got[i].n_repeated > 0
        assert got[i].n_repeated == 0 or long or shares(passages.SPAN)
    assert missed <= 0.01 * total


def test_passages_of_odd_rows(odd, empty, odd_rows):
    rows = passages.repeated_passages(odd.withColumns({"uid": F.lit(1), "mark": F.lit("x"), "node": F.lit(2.0)})).collect()
    assert len(rows) == len(odd_rows)
    assert sorted(r.doc_id for r in rows if r.removed_chars) == [2, 2]
    assert all(r.kept_in == ([1] if r.removed_chars else []) for r in rows)  # of ties the smallest id keeps
    assert passages.repeated_passages(empty).count() == 0


def test_fingerprints_guarantee(spark):
    rng = random.Random(11)
    passage = words(rng, passages.SPAN + passages.WINDOW - 1)
    for _ in range(50):
        a, b = (set(passages.fingerprints(word_hashes(f"{words(rng, rng.randint(0, 60))} {passage} {words(rng, 30)}".encode()))[1].tolist()) for _ in range(2))
        assert a & b


# --- languages ------------------------------------------------------------------------------------------------------


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in langid._new_weights(rng, 3).items()}
    codes, label = rng.integers(0, 256, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    valid = np.ones((7, 5), bool)
    valid[5:, 2] = False
    grads, _ = langid._gradients(w, codes, valid, label)
    for key in ("hg_f", "hc_b", "out_f", "bias"):
        at = tuple(0 for _ in w[key].shape)
        change = []
        for sign in (1, -1):
            moved = {k: v.copy() for k, v in w.items()}
            moved[key][at] += sign * 1e-2
            change.append(langid._gradients(moved, codes, valid, label)[1])
        assert abs((change[0] - change[1]) / 2e-2 - grads[key][at]) < 2e-3


def test_held_out_accuracy(spark, small):
    rows = queries.op5_langid(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_languages_of_odd_rows(docs, odd, empty, odd_rows):
    model = langid.fit(docs, per_lang=40, spans=4)
    rows = langid.predict(odd, model).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert langid.fit(empty) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    with pytest.raises(ValueError, match="score"):
        langid.predict(odd.withColumnRenamed("lang", "score"), model)


def plain_probabilities(model, raw):
    """One byte after the other, with sigmoids written out."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    total = np.zeros(len(model.langs))
    for at in range(0, len(raw), langid.WINDOW):
        codes = np.frombuffer(raw[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0"), np.uint8)
        logits = np.tile(w["bias"], (langid.WINDOW, 1))
        for d in "fb":
            h = np.zeros(langid.HIDDEN)
            for t in range(langid.WINDOW) if d == "f" else reversed(range(langid.WINDOW)):
                gates = sigmoid(2 * (w[f"xg_{d}"][codes[t]] + h @ w[f"hg_{d}"]))
                r, z = gates[: langid.HIDDEN], gates[langid.HIDDEN :]
                h = h + z * (np.tanh(w[f"xc_{d}"][codes[t]] + (r * h) @ w[f"hc_{d}"]) - h)
                logits[t] += h @ w[f"out_{d}"]
        p = np.exp(logits - logits.max(1, keepdims=True))
        total += (p / p.sum(1, keepdims=True))[: len(raw) - at].sum(0)
    return total / len(raw)


def test_pooling_matches_a_plain_network(monkeypatch):
    rng = np.random.default_rng(2)
    model = langid.Model(("a", "b", "c"), langid._new_weights(rng, 3))
    texts = [rng.integers(1, 256, n).astype(np.uint8).tobytes().lower() for n in (1, 95, 96, 97, 700, 5, 2000)]
    want = [plain_probabilities(model, x) for x in texts]
    for size in (96, 960, langid.SLICE):
        monkeypatch.setattr(langid, "SLICE", size)
        assert np.allclose(list(langid.pooled(model, texts)), want, atol=1e-5)


def test_ties_of_languages_and_a_long_text(spark):
    flat = langid.Model(("a", "b"), {k: np.zeros_like(v) for k, v in langid._new_weights(np.random.default_rng(0), 2).items()})
    rows = [(1, "word " * 2_000_000), (2, "x"), (3, "7" * 3_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    got = langid.predict(df, flat).select("doc_id", "key", "lang_pred", "score").collect()
    assert [tuple(r) for r in got] == [(1, 1, "a", 0.5), (2, 1, "a", 0.5), (3, 1, "und", 0.0)]


# --- mixing ---------------------------------------------------------------------------------------------------------


def filled(sizes, weights, most):
    """Targets by handing out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if w[s] * level > most * sizes[s]]
        if not over:
            return fixed | {s: w[s] * level for s in rest}
        fixed |= {s: most * sizes[s] for s in over}


def test_mix_meets_its_targets(spark, small, docs):
    rows = queries.op3_mix(spark, small).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        assert r.size == len(WORD.findall(r.text or ""))
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in filled(sizes, (5, 2, 1), 3).items():
        assert abs(target[s] - t) < 1e-6
        assert abs(taken[s] - t) <= largest[s]
    again = queries.op3_mix(spark, small).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in rows}


def test_split_tree_margins():
    rng = np.random.default_rng(1)
    quotas, caps = np.array([5, 0, 17, 40]), np.array([16, 16, 15, 15])
    dealt = mix.split_tree(quotas, caps, rng)
    assert (dealt.sum(1) == quotas).all() and (dealt.sum(0) == caps).all() and (dealt >= 0).all()


def test_mix_of_odd_rows(spark, odd, empty, odd_rows):
    plan = mix.mix_plan(odd, shards=4).collect()
    assert len(plan) == len(odd_rows)
    sizes = Counter()
    for r in plan:
        sizes[r.source] += r.size
    want = filled(sizes, (5, 2, 1), 3)
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in plan)
    out = mix.mixed(odd, shards=4)
    assert out.columns == [*odd.columns, "shard"]
    assert out.count() == sum(len(r.copies) for r in plan)
    assert mix.mix_plan(empty).count() == 0
    names = ["key", "start", "none", "src", "bucket", "rank", "part", "base", "ends", "full", "quota", "filler", "row"]
    more = mix.mix_plan(odd.withColumns({c: F.lit(c) for c in names}), shards=4)
    assert all(r[c] == c for r in more.collect() for c in names)
    six = spark.createDataFrame([(1, "a b c d e f g h i j", "en", "a", 1)] * 6 + [(2, " ".join("abcdefghij" * 5), "en", "b", 1)], odd.schema)
    taken = Counter()
    for r in mix.mix_plan(six, shards=4).collect():
        taken[r.source, r.target] += r["size"] * len(r.copies)
    assert all(abs(n - target) <= 50 if s == "b" else abs(n - target) <= 10 for (s, target), n in taken.items())
    with pytest.raises(ValueError, match="target"):
        mix.mix_plan(odd.withColumnRenamed("lang", "target"))


# --- packing --------------------------------------------------------------------------------------------------------

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "don't stop, it's 12.5% OFF!!! (really)...", "İstanbul ÉCOLE naïve J̌ T̈ é ́x", "a<|endoftext|>b <|ENDOFTEXT|> c", "x,. y.; ÷. ×! »., é. ß! 日本語。 ok", "tab\tnew\nline\x0bv\x0cf\rr\x85n\xa0b",
    "the&&& ing### a%%% end$$$", "'s 't ''' 'll we'll.", "",
]


@pytest.mark.parametrize("text", HARD)
def test_words_have_the_ids_of_the_text(text):
    table = pack.TokenTable(PATH)
    rows = table.rows(text.encode())
    table.learn()
    assert table.encoded(rows).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_token_table_shrinks():
    table = pack.TokenTable(PATH)
    for text in ("alpha beta gamma", "delta epsilon"):
        table.rows(text.encode())
        table.learn()
    table.shrink(2)
    rows = table.rows(b"alpha zeta beta")
    table.learn()
    assert table.encoded(rows).tolist() == Tokenizer.from_file(PATH).encode("alpha zeta beta", add_special_tokens=False).ids


def check_packing(rows, texts, capacity):
    tokenizer, pieces = Tokenizer.from_file(PATH), Counter()
    for key, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            pieces[key, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for placed in places.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_packing(spark, small, texts):
    rows = queries.op9_pack(spark, small).collect()
    used = check_packing(rows, texts.items(), 4096)
    assert used <= sum(r.length for r in rows) / 4096 * 1.02 + 2


def test_packing_of_odd_rows(odd, empty, odd_rows):
    rows = pack.pack(odd, PATH, capacity=64, with_ids=True).collect()
    check_packing(rows, [(r[0], r[1]) for r in odd_rows], 64)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert pack.pack(empty, PATH).count() == 0


def test_two_pieces_replace_the_smallest():
    patterns = pack.plan_bins({60: 1, 30: 1, 25: 1, 15: 1}, 100)
    assert patterns[0] == ((60, 25, 15), 1)
    left = Counter()
    for bin_, times in patterns:
        assert sum(bin_) <= 100
        left.update({x: times * bin_.count(x) for x in set(bin_)})
    assert left == {60: 1, 30: 1, 25: 1, 15: 1}


# --- archives -------------------------------------------------------------------------------------------------------


def test_archives(spark):
    big = "é" * 600
    rows = [(1, "http://a/ b", big), (5, None, big), (3, "http://c", big), (2, "http://d", "small"), (4, "http://e", "small"), (6, "http://f", None), (None, "http://g", big), (7, "http://h", "WARC/1.1\r\n\r\nx\r\n\r\n")]
    out = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), per_file=3).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == len(rows)
    for key, _, html in rows:
        data = (html or "").encode()
        assert (got[key].payload_bytes, got[key].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        1: ("revisit", 5), 3: ("revisit", 5), None: ("revisit", 5), 5: ("response", None), 2: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None)}
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    same = spark.createDataFrame([(1, "", big, "x")] * 3 + [(2, " ", big, "y")], "page_id long, url string, html string, record_type string")
    again = warc.archive_pages(same).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in again) == [(1, "revisit", 2)] * 3 + [(2, "response", None)]
    assert len({r.record_id for r in again}) == 4


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip_and_damage(version):
    records = [(b"http://x/%20", "19990102030405", "text/html", b"HTTP/1.0 200 OK\r\n\r\n\nbody\n\n"), (b"http://y/", "19990102030405", "text/plain", b"")]
    data = warc.arc_file("a.arc", version, records)
    back = list(warc.arc_records(data))
    assert [(r["URL"], r["Archive-date"].decode(), r["content"]) for r in back] == [(u, d, c) for u, d, _, c in records]
    with pytest.raises(ValueError):
        list(warc.arc_records(data[: data.index(b"body")]))
    with pytest.raises(ValueError, match="version"):
        list(warc.arc_records(data.replace(f"\n{version} 0 ".encode(), b"\n9 0 ", 1)))


def test_warc_files_are_checked():
    record = {"record_type": "response", "record_id": "urn:uuid:1", "date": "2000-01-01T00:00:00Z", "uri": "u", "payload_digest": "00" * 20, "block": b"h\r\n\r\nx"}
    data = warc.warc_record(record) + b"\r\n\r\n"
    fields, block = next(warc.warc_records(gzip.decompress(gzip.compress(data))))
    assert (fields["warc-type"], block) == ("response", b"h\r\n\r\nx")
    with pytest.raises(ValueError):
        list(warc.warc_records(data[:-3]))
