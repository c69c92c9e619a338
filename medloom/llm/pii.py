r"""Personal data: exact base patterns, and bootstrapped contextual extraction of what they do not see.

The base finds e-mail addresses, IP addresses, card numbers that pass Luhn's check, and phone numbers, leftmost and without
overlaps for each kind. Its finds are the seeds. A lexical pattern is the two words before an identifier. Identifier-like
words, and runs of number words that look like a card or phone number, give a bipartite graph of patterns and instances; in
each round a pattern's confidence for a kind is the share of its occurrences, over all documents, that precede believed
instances of that kind, and patterns with at least SUPPORT different instances and CONFIDENCE believe in the unseen
instances they precede, if these look like their kind. A value keeps the kind it was first believed to be of, so scores only
rise; rounds end when none rises by more than MOVED. Both are joins and aggregates of pre-aggregated counts. What is
believed in the end is found wherever it occurs, whatever white space parts its words.
Only SQL expressions are used.

Cases: a null text is an empty one; null and repeated ids and repeated rows are kept; overlaps between kinds are all
listed; runs of millions of digits or labels pass in linear time; an empty table gives no rows; the input's columns are
kept, whatever their names but `spans` (array of kind, start, end in code points, end exclusive, base flag), which raises
an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medloom.llm.common import SPACE, stored

# The kinds in order, their patterns, and a private-use mark that stands for a seed in a masked text. The
# patterns never give back what they took, and begin where a run of their characters does (or the last match ended), so
# Java's engine neither recurses nor starts over inside long runs; what they match is the same.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # the shortest that can have 13 digits; a shorter run of digits has no match that passes anyway
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MARK = "\ue000"
#: Card and phone numbers written as several words.
CARD_RUN = r"[0-9](?:[\x20-]?[0-9]){11,18}"
PHONE_RUN = r"[(]?[0-9](?:[).-]{0,2}\x20?[(.-]?[0-9]){6,14}"
#: What an unseen instance of a kind must look like.
SHAPES = {
    "email": r"^[^@\s]+(@|\[at\]|\(at\))[^@\s]+$",
    "ip": r"^[0-9]+([.:\[\]()-]+[0-9]+){3}$",
    "card": r"^[0-9]([ -]?[0-9]){11,18}$",
    "phone": rf"^(?:[(0-9][0-9().-]{{5,13}}[0-9]|(?=.*\x20){PHONE_RUN})$",
}
#: The longest run at the start of joined words, and the most words that it can have.
RUN, RUN_WORDS = rf"^[^A-Za-z0-9(+]*({CARD_RUN}|{PHONE_RUN})(?=[^A-Za-z0-9@{MARK}]*(?:\x20|$))", 19
SUPPORT, CONFIDENCE, MOVED = 3, 0.5, 0.01
#: One of so many documents is counted first; so many contexts are told by their hashes, more by a join only.
PART, FEW = 16, 16_384
CHUNK = 256
SPAN = "struct<kind: int, start: int, end: int, value: string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.filter(F.split(F.reverse(_digits(value)), ""), lambda c: c != "")

    def add(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(digits, add), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        small = lambda p: (F.length(p) == 0) | (F.length(p) <= 3) & F.coalesce(p.try_cast("int") <= 255, F.lit(False))
        return F.forall(F.split(value, r"\."), lambda p: small(F.ltrim(p, F.lit("0"))))
    if kind == "card":
        return n.between(13, 19) & _luhn(value)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _chunks(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, CHUNK))


def _running(values: Column, begin: Column, out, after) -> Column:
    """For each value what `out` makes of the state and of it; `after` is the next state. Short arrays only: it copies."""
    zero = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct(after(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(out(acc["at"], x))).alias("out"))
    return F.aggregate(values, zero, step, lambda acc: acc["out"])


def _starts(parts: Column) -> Column:
    """Where the `size` of each part (gap, size) begins when gaps and sizes follow one another.

    Running sums by chunks of CHUNK parts, so that long arrays are not copied once for each of their members.
    """
    chunks = _chunks(parts)
    whole = F.transform(chunks, lambda chunk: F.aggregate(chunk, F.lit(0), lambda at, x: at + x["gap"] + x["size"]))
    begins = _running(whole, F.lit(0), lambda at, x: at, lambda at, x: at + x)
    return F.flatten(F.zip_with(chunks, begins, lambda chunk, at: _running(chunk, at, lambda n, x: n + x["gap"], lambda n, x: n + x["gap"] + x["size"])))


def _reached(ends: Column) -> Column:
    """For each number the largest before it, 0 for the first; by chunks, as the starts."""
    chunks = _chunks(ends)
    begins = _running(F.transform(chunks, F.array_max), F.lit(0), lambda at, x: at, F.greatest)
    return F.flatten(F.zip_with(chunks, begins, lambda chunk, at: _running(chunk, at, lambda n, x: n, F.greatest)))


def _between(text: Column, spans: Column) -> Column:
    """What stands before each of some sorted spans (start, end) that do not overlap, since the one before it.

    A text is cut at every CHUNK spans first, and these parts at each span: finding a place in a text takes time in
    proportion to it, so long texts with many spans would take the square otherwise.
    """
    end_before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))

    def chunk(part: Column, c: Column) -> Column:
        begin = end_before(c * CHUNK)
        piece = F.struct(F.substring(text, begin + 1, F.element_at(part, -1)["end"] - begin).alias("text"), begin.alias("begin"))

        def cut(p: Column) -> Column:
            before = lambda i: F.coalesce(F.get(part, i - 1)["end"], p["begin"])
            return F.transform(part, lambda x, i: F.substring(p["text"], before(i) - p["begin"] + 1, x["start"] - before(i)))

        return F.element_at(F.transform(F.array(piece), cut), 1)

    return F.when(F.size(spans) > 0, F.flatten(F.transform(_chunks(spans), chunk))).otherwise(F.array().cast("array<string>"))


def _places(text: Column, pattern: Column, matches: Column) -> Column:
    """(start, value) of the matches of a pattern: the text between matches and the matches themselves add up."""
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    parts = F.zip_with(between, matches, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("size")))
    return F.zip_with(_starts(parts), matches, lambda at, m: F.struct(at.alias("start"), m.alias("value")))


def _spans(kind: str, text: Column, matches: Column) -> Column:
    """Valid matches with their places."""
    places = F.filter(_places(text, F.lit(PATTERNS[kind]), matches), lambda x: _valid(kind, x["value"]))
    one = lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value"))
    return F.transform(places, one)


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with `base`: the base spans by kind, then start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    every = {k: F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    every["email"] = F.when(text.contains("@"), every["email"]).otherwise(none)
    every["phone"] = F.when(text.contains("+"), every["phone"]).otherwise(none)
    if clash := {"base", *[f"_{k}" for k in KINDS]} & set(docs.columns):
        raise ValueError(f"columns clash with the operator's: {sorted(clash)}")
    df = docs.withColumns({f"_{k}": v for k, v in every.items()})
    empty = F.array().cast(f"array<{SPAN}>")
    each = [F.when(F.size(f"_{k}") > 0, _spans(k, text, F.col(f"_{k}"))).otherwise(empty) for k in KINDS]
    return df.withColumn("base", F.concat(*each)).drop(*[f"_{k}" for k in KINDS])


# --- bootstrapping --------------------------------------------------------------------------------------------------


def _masked(based: DataFrame, text_col: str) -> DataFrame:
    """The words of each text, its seeds masked by their kind first; of overlapping seeds those that follow another."""
    text = F.col(text_col)
    order = F.array_sort(F.transform("base", lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"])))
    df = based.withColumn("base", order)
    df = df.withColumn("base", F.filter("base", lambda s, i: s["start"] >= F.coalesce(F.get("base", i - 1)["end"], F.lit(0))))

    mark = lambda s: F.concat(F.lit(MARK), s["kind"].cast("string"), F.lit(MARK), F.translate(s["value"], " ", ""), F.lit(MARK))
    pieces = F.zip_with(_between(text, F.col("base")), "base", lambda t, s: F.concat(t, mark(s)))
    rest = F.substring(text, F.element_at("base", -1)["end"] + 1, F.length(text))
    masked = F.when(F.size("base") == 0, text).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return df.select(F.split(masked, SPACE).alias("words"))


def _before(i: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.get("words", i - 2), F.get("words", i - 1)))


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, f"^[^A-Za-z0-9(+{MARK}]++|(?<![^A-Za-z0-9){MARK}])[^A-Za-z0-9){MARK}]++$", "")


def _in_run(word: Column, after: Column) -> Column:
    """Whether a word and the one after it can be parts of a number."""
    return word.rlike(r"^[^A-Za-z0-9@]*[0-9][0-9().-]*$") & after.rlike("^[(]?[0-9]")


def _instances(based: DataFrame, text_col: str) -> DataFrame:
    """(context, value, kind) for each identifier-like word and run of number words; kind is null for what is no seed."""

    # all else is left out at once: each of the expressions below is computed anew for every word that is let in
    some = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].rlike(f"[0-9@{MARK}]"))

    def word(x: Column) -> Column:
        bare, i = x["bare"], x["i"]
        seed = f"{MARK}([0-9]){MARK}([^{MARK}]+){MARK}"
        single = F.when(bare.rlike(seed), F.struct(F.regexp_extract(bare, seed, 2).alias("value"), F.regexp_extract(bare, seed, 1).cast("int").alias("kind")))
        single = single.when((F.length(bare) >= 6) & bare.rlike("[0-9@]"), F.struct(bare.alias("value"), F.lit(None).cast("int").alias("kind")))
        run = F.when(_in_run(x["w"], F.get("words", i + 1)), F.regexp_extract(F.array_join(F.slice("words", i + 1, RUN_WORDS), " "), RUN, 1))
        return F.struct(_before(i).alias("context"), single.alias("single"), run.alias("run"))

    df = _masked(based.where(F.col(text_col).rlike("[0-9@]")), text_col)
    bare = F.transform(some, lambda x: F.struct(x["w"].alias("w"), x["i"].alias("i"), _bare(x["w"]).alias("bare")))
    found = df.select(F.inline(F.transform(bare, word))).where(~F.col("context").contains(MARK))
    run = F.struct(F.col("run").alias("value"), F.lit(None).cast("int").alias("kind"))
    each = F.array("single", F.when(F.col("run").contains(" "), run))
    return found.select("context", F.explode(each).alias("x")).where("x is not null").select("context", "x.*")


def _totals(based: DataFrame, text_col: str, contexts: DataFrame) -> DataFrame:
    """(context, total): the occurrences of these contexts before any word of all documents."""
    every = F.transform("words", lambda w, i: _before(i))
    # all other words are left out before they are rows, while the contexts are few
    marks = [r[0] for r in contexts.select(F.hash("context")).distinct().limit(FEW + 1).collect()]
    if len(marks) <= FEW:
        every = F.filter(every, lambda c: F.hash(c).isin(marks))
    every = _masked(based, text_col).select(F.explode(every).alias("context"))
    return every.groupBy("context").agg(F.count("*").alias("total")).join(contexts.select("context"), "context", "left_semi")


def _looks(kind: Column, value: Column) -> Column:
    return F.coalesce(*[F.when(kind == i, value.rlike(SHAPES[k])) for i, k in enumerate(KINDS)], F.lit(False))


def discovered(based: DataFrame, text_col: str = "text") -> DataFrame:
    """(value, kind): what the patterns believe in after all rounds, without the seeds."""
    graph = _instances(based, text_col).groupBy("context", "value", "kind").agg(F.count("*").alias("n"))
    # what looks like no kind is never believed, so neither is a context that precedes nothing else
    likely = F.exists(F.array(*[F.col("value").rlike(p) for p in SHAPES.values()]), lambda fits: fits)
    graph = stored(graph.where(F.col("kind").isNotNull() | likely), "pii-graph")
    seeds = graph.where("kind is not null").select("value", "kind").distinct()
    # a context of fewer different values never becomes a pattern, nor does one that occurs too often for its confidence;
    # for most of the common ones, the occurrences in a part of the documents prove that already
    contexts = graph.groupBy("context").agg(F.count_distinct("value").alias("many"), F.sum("n").alias("hits"))
    contexts = stored(contexts.where(F.col("many") >= SUPPORT).select("context", "hits"), "pii-contexts")
    part = _totals(based.where(F.pmod(F.xxhash64(text_col), F.lit(PART)) == 0), text_col, contexts)
    often = stored(part.join(contexts, "context").where(CONFIDENCE * F.col("total") > F.col("hits")).select("context"), "pii-often")
    totals = _totals(based, text_col, stored(contexts.join(often, "context", "left_anti").select("context"), "pii-contexts"))
    edges = graph.groupBy("context", "value").agg(F.sum("n").alias("n")).join(stored(totals, "pii-totals"), "context")
    edges = stored(edges, "pii-edges")
    sure = seeds.withColumns({"score": F.lit(1.0), "seed": F.lit(True), "moved": F.lit(0.0)})
    believed = stored(sure, "pii-believed")
    while True:
        links = edges.join(believed, "value")
        patterns = links.groupBy("context", "kind", "total").agg(
            F.sum(F.col("n") * F.col("score")).alias("hits"), F.count("*").alias("many")
        )
        # a word and the run it begins can both be believed at one place
        patterns = patterns.withColumn("confidence", F.least(F.lit(1.0), F.col("hits") / F.col("total")))
        patterns = patterns.where((F.col("many") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE))
        fresh = edges.join(patterns.select("context", "kind", "confidence"), "context").where(_looks(F.col("kind"), F.col("value")))
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        fresh = fresh.groupBy("value", "kind").agg((1 - doubt).alias("score"))
        new = fresh.join(seeds, "value", "left_anti").where(F.col("score") >= CONFIDENCE)
        old = believed.where("not seed").select("value", F.col("kind").alias("was"), F.col("score").alias("before"))
        new = new.join(old, "value", "left").where("was is null or was = kind")
        best = new.groupBy("value").agg(F.max_by(F.struct("kind", "score", "before"), F.struct("score", -F.col("kind"))).alias("x")).select("value", "x.*")
        moved = (F.col("score") - F.coalesce("before", F.lit(0.0))).alias("moved")
        believed = stored(sure.unionByName(best.select("value", "kind", "score", F.lit(False).alias("seed"), moved)), "pii-believed")
        if (believed.agg(F.max("moved")).first()[0] or 0.0) <= MOVED:
            return believed.where("not seed").select("value", "kind")


def _found(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(key, kind, start, end): where known values stand, as words or runs of words, in rows (key, text), each row's once.

    A text is cut into words with their places in one pass; words (and runs that begin at a number word) that hold a digit
    or an at sign meet the known values, so the work does not depend on how many values a text holds.
    """
    most = known.agg(F.max(F.size(F.split("value", " ")))).first()[0]
    text = F.col("text")
    df = docs.where(text.rlike("[0-9@]")).dropDuplicates(["key"])
    df = df.select("key", F.split(text, SPACE).alias("words"), F.regexp_extract_all(text, F.lit(SPACE), F.lit(0)).alias("gaps"))
    parts = F.transform("words", lambda w, i: F.struct(F.coalesce(F.length(F.get("gaps", i - 1)), F.lit(0)).alias("gap"), F.length(w).alias("size")))
    df = df.select("key", "words", _starts(parts).alias("starts"))
    some = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].rlike("[0-9@]"))

    def place(x: Column, n: Column) -> Column:
        """The n words from x on: their value, and where it stands, whatever white space parts them."""
        joined = F.array_join(F.slice("words", x["i"] + 1, n), " ")
        value = _bare(joined)
        lead, last = F.instr(joined, value) - 1, x["i"] + n - 1
        end = F.get("starts", last) + F.length(F.get("words", last)) - (F.length(joined) - lead - F.length(value))
        return F.struct(value.alias("value"), (F.get("starts", x["i"]) + lead).alias("start"), end.alias("end"))

    left = lambda x: F.least(F.lit(most), F.size("words") - x["i"])
    upto = lambda x: F.when(_in_run(x["w"], F.get("words", x["i"] + 1)), F.sequence(F.lit(1), left(x))).otherwise(F.array(F.lit(1)))
    each = F.flatten(F.transform(some, lambda x: F.transform(upto(x) if most > 1 else F.array(F.lit(1)), lambda n: place(x, n))))
    return df.select("key", F.inline(each)).join(known, "value").select("key", "kind", "start", "end").distinct()


def _apart(found: DataFrame, base: DataFrame) -> DataFrame:
    """The found spans (key, kind, start, end) that meet no base span (key, start, end) and are no part of a longer one of their kind.

    Sweeps over a row's sorted spans: the furthest end before a place, and the nearest start behind it.
    """
    flag = lambda df, b: df.select("key", "start", "end", F.lit(b).alias("base"), F.col("kind") if not b else F.lit(None).cast("int").alias("kind"))
    rows = flag(found, False).unionByName(flag(base, True))
    up, down = W.partitionBy("key").orderBy("start"), W.partitionBy("key").orderBy(F.col("start").desc())
    reached = F.max(F.when(F.col("base"), F.col("end"))).over(up.rangeBetween(W.unboundedPreceding, 0))
    behind = F.min(F.when(F.col("base"), F.col("start"))).over(down.rangeBetween(W.unboundedPreceding, -1))
    rows = rows.withColumns({"reached": reached, "behind": behind}).where("not base and coalesce(reached <= start, true) and coalesce(behind >= end, true)")
    order = W.partitionBy("key", "kind").orderBy("start", F.col("end").desc()).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("covered", F.max("end").over(order)).where("coalesce(covered < end, true)")
    return rows.select("key", "kind", "start", "end")


def find_personal(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents with `spans`: base spans and discovered ones, by kind, then start."""
    if "spans" in docs.columns:
        raise ValueError("columns clash with the operator's: ['spans']")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    based = base_spans(rows)
    known = stored(discovered(based, "text"), "pii-discovered")
    flag = lambda column: F.transform(
        column, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("base"))
    )
    if known.isEmpty():
        return based.withColumn("spans", flag("base")).select("row.*", "spans")
    found = stored(_found(rows.select("key", "text"), known), "pii-found")
    held = rows.join(found.select("key").distinct(), "key", "left_semi").select("key", "text").dropDuplicates(["key"])
    base = base_spans(held).select("key", F.inline("base")).select("key", "start", "end")
    one = F.struct("kind", "start", "end", F.lit(False).alias("base"))
    extra = stored(_apart(found, base).groupBy("key").agg(F.collect_list(one).alias("more")), "pii-more")
    df = based.join(extra, "key", "left")
    none = F.array().cast("array<struct<kind: int, start: int, end: int, base: boolean>>")
    return df.withColumn("spans", F.array_sort(F.concat(flag("base"), F.coalesce("more", none)))).select("row.*", "spans")


def span_text(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(rows: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """The rows with each span of the text replaced by its kind in brackets.

    Spans that overlap are one stretch, named by the one that begins first, which ends where the furthest of them does.
    """
    if clash := {"_order", "_far", "_heads", "_stretches", "_before"} & set(rows.columns):
        raise ValueError(f"columns clash with the operator's: {sorted(clash)}")
    text, last = F.col(text_col), F.array_max(F.transform("_order", lambda s: s["end"]))
    order = F.array_sort(F.transform(spans_col, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    df = rows.withColumn("_order", order).withColumn("_far", _reached(F.transform("_order", lambda s: s["end"])))
    far = F.zip_with("_order", "_far", lambda s, r: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), r.alias("reached")))
    df = df.withColumn("_heads", F.filter(far, lambda s: s["start"] >= s["reached"]))
    stretch = F.transform("_heads", lambda s, i: F.struct(s["start"].alias("start"), F.coalesce(F.get("_heads", i + 1)["reached"], last).alias("end"), s["kind"].alias("kind")))
    df = df.withColumn("_stretches", stretch).withColumn("_before", _between(text, F.col("_stretches")))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    out = F.zip_with("_before", "_stretches", lambda t, s: F.concat(t, F.element_at(names, s["kind"] + 1)))
    whole = F.concat(F.array_join(out, ""), F.substring(text, last + 1, F.length(text)))
    return df.withColumn(text_col, F.when(F.size(spans_col) > 0, whole).otherwise(text)).select(rows.columns)
