"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Regular expressions find the base entities.  These seed a graph between lexical patterns
(the word in front, the two words in front, the word behind; with the kind) and instances (the
values that stand there).  In turns, a pattern's confidence is the share of its instances
that are believed (instances of its kind's form that nobody knows yet count half), and an
instance that is no base entity is believed by how sure its patterns make it; what is believed supports further patterns in the next turn, until a
turn adds nothing.  Patterns of enough support and confidence mark further values of a
plausible form wherever they stand in them.

The time that a text takes grows with its length: places are running sums over arrays,
made block by block, and base entities are blanked out before other values are looked for.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import checkpointed

KINDS = ("email", "ip", "card", "phone")
#: Matches of the contract's expressions, written so that a match begins where a run begins and never backs up.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9]){15,}+",  # shorter runs can't have 16 digits
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain to be searched at all.
HINTS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9][\\x20-]?[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
#: Words with a digit or an at sign, which may be identifiers.  \x01 stands where something else was found.
_WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@\x01]*+[0-9@][^\x20\x09-\x0D\x01]*+(?!\x01)"
#: Groups of digits, 7 to 19 in all, joined by single spaces, dots, dashes or brackets; as many whole groups as fit.
_RUN = r"(?<![^\x20\x09-\x0D])[(+]?[0-9](?:(?:[ .()-]|\) | \(|\)-)?[0-9]){6,18}(?![0-9\p{L}@])"
#: Forms that an unseen identifier of a kind may have.
FORMS = {"email": r"^[^@]+@[^@]+$", "ip": r"^[0-9]+([.:][0-9]+){3,}$", "card": r"^([0-9][ -]?){13,19}$", "phone": r"^[(+]?[0-9][0-9().-]{6,18}$"}
SUPPORT, CONFIDENCE, UNKNOWN = 5, 0.9, 0.5
_SPACE, _INK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
PIECES = "array<struct<gap:string,value:string,ok:boolean>>"
SPAN = "array<struct<kind:int,start:int,end:int,value:string,patterns:array<string>>>"
BARE = "array<struct<kind:int,start:int,end:int>>"
_BLOCK = 1024


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], depth: int = 3) -> Column:
    """For each entry what combine makes of 0 and all entries before it: within its block of 16, and of the blocks before by the same way."""

    def of(n: Column) -> Column:
        if depth == 0:
            return F.transform(n, lambda _, i: F.aggregate(F.slice(n, F.lit(1), i), F.lit(0), combine))
        blocks = F.sequence(F.lit(0), F.shiftright(F.size(n) + 15, 4) - 1)
        sums = F.when(F.size(n) > 0, F.transform(blocks, lambda b: F.aggregate(F.slice(n, b * 16 + 1, F.lit(16)), F.lit(0), combine))).otherwise(F.array().cast("array<int>"))
        return bound(running(sums, combine, depth - 1), lambda h: F.transform(n, lambda _, i: F.aggregate(F.slice(n, i - i.bitwiseAND(F.lit(15)) + 1, i.bitwiseAND(F.lit(15))), F.get(h, F.shiftright(i, 4)), combine)))

    return bound(values, of)


def pieces(text: Column, pattern: str, ok: Callable[[Column], Column]) -> Column:
    """PIECES of a text: what lies before each leftmost non-overlapping match, the match, and whether it counts; at last what lies behind them, without a match."""
    cut = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    return F.transform(cut, lambda p: F.struct(p["gap"].alias("gap"), p["value"].alias("value"), (p["value"].isNotNull() & F.coalesce(ok(p["value"]), F.lit(False))).alias("ok")))


def patterns_of(before: Column, gap: Column, behind: Column) -> Column:
    """Patterns that a value stands in: the word in front and the two in front, which a match before may have a part in, and the word behind."""
    alone = F.regexp_replace(gap, r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    front = F.when(alone == "", F.coalesce(before, F.lit(""))).otherwise(alone)
    last, two = F.regexp_extract(front, rf"(?<!{_INK}){_INK}++$", 0), F.regexp_extract(front, rf"(?<!{_INK})({_INK}++){_SPACE}++({_INK}++)$", 0)
    found = F.array(F.concat(F.lit("< "), last), F.concat(F.lit("<< "), F.regexp_replace(two, f"{_SPACE}+", " ")), F.concat(F.lit("> "), F.regexp_extract(F.coalesce(behind, F.lit("")), rf"^[^\p{{L}}\p{{N}}]*+({_INK}++)", 1)))
    return F.transform(F.filter(found, lambda x: ~x.endswith(" ") & ~x.contains("\x01")), F.lower)


def spans(cut: Column, kind: int) -> Column:
    """SPAN of the matches that count, in code points, ends exclusive."""

    def place(ps: Column) -> Column:
        sizes = F.transform(ps, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["value"]), F.lit(0)))

        def at(before: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                start = F.get(before, i) + F.length(p["gap"])
                said = F.when(p["ok"], patterns_of(F.get(ps, i - 1)["value"], p["gap"], F.get(ps, i + 1)["gap"]))
                return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(p["value"])).alias("end"), F.when(p["ok"], p["value"]).alias("value"), said.alias("patterns"))

            return F.filter(F.transform(ps, one), lambda s: s["value"].isNotNull())

        return bound(running(sizes, lambda a, b: a + b), at)

    found = F.when(F.exists(cut, lambda p: p["ok"]), bound(cut, place))
    return F.coalesce(found, F.array().cast(SPAN))


def blanked(cut: Column) -> Column:
    """The text with \\x01 for every character, but white space, of the matches that count."""
    return F.array_join(F.transform(cut, lambda p: F.concat(p["gap"], F.when(p["ok"], F.regexp_replace(p["value"], _INK, "\x01")).otherwise(F.coalesce(p["value"], F.lit(""))))), "")


def both_blanked(one: Column, two: Column) -> Column:
    """Of two blanked forms of a text one that has the words blanked that either has; a word in which both have something goes whole."""
    cut = rf"(?={_SPACE})"
    pick = lambda a, b: F.when(~b.contains("\x01"), a).when(~a.contains("\x01"), b).otherwise(F.regexp_replace(b, _INK, "\x01"))
    return F.array_join(F.zip_with(F.split(one, cut, -1), F.split(two, cut, -1), pick), "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: (F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & (F.substring(F.regexp_replace(p, "^0+(?=[0-9])", ""), 1, 3).cast("int") <= 255)
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def fits(kind: str, value: Column) -> Column:
    """Whether a value has the form of a kind, spaces between its groups left out."""
    return F.replace(value, F.lit(" "), F.lit("")).rlike(FORMS[kind])


def fits_kind(kind: Column, value: Column) -> Column:
    return reduce(lambda c, i: c | ((kind == i) & fits(KINDS[i], value)), range(len(KINDS)), F.lit(False))


def _is_kind(i: int, span: Column) -> Column:
    return span["kind"] == i


def with_pieces(rows: DataFrame) -> DataFrame:
    """rows (text, ...) and PIECES for each kind, null where a text has nothing like it."""
    return rows.withColumns({f"_{k}": F.when(F.col("text").rlike(HINTS[k]), pieces(F.col("text"), PATTERNS[k], partial(valid, k))) for k in KINDS})


def base_spans() -> Column:
    """All base spans of a text, by kind, then start, from the columns of ``with_pieces``."""
    return F.concat(*[spans(F.col(f"_{k}"), i) for i, k in enumerate(KINDS)])


def trimmed(s: Column) -> Column:
    """A span without what is neither letter nor digit at its ends."""
    lead = F.length(s["value"]) - F.length(F.regexp_replace(s["value"], r"^[^\p{L}0-9(+]+", ""))
    core = F.regexp_replace(F.regexp_replace(s["value"], r"^[^\p{L}0-9(+]+", ""), r"(?<![^\p{L}0-9])[^\p{L}0-9]++$", "")
    return F.struct(s["kind"].alias("kind"), (s["start"] + lead).alias("start"), (s["start"] + lead + F.length(core)).alias("end"), core.alias("value"), s["patterns"].alias("patterns"))


def read(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, base, maybe) without texts, written down.  mark tells texts of one doc_id apart.

    base has the base spans; maybe has, as kind -1, what may be an identifier and touches
    none of them: groups of digits with spaces between that have a form as a whole, and
    words outside these.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_pieces(rows).withColumns({f"blank_{k}": F.when(F.exists(f"_{k}", lambda p: p["ok"]), blanked(F.col(f"_{k}"))) for k in KINDS} | {"base": base_spans()})
    blank = F.col(f"blank_{KINDS[0]}")
    for k in KINDS[1:]:
        other = F.col(f"blank_{k}")
        blank = F.when(other.isNull(), blank).when(blank.isNull(), other).otherwise(both_blanked(blank, other))
    rows = rows.withColumn("blank", F.coalesce(blank, F.col("text")))
    formed = lambda v: v.contains(" ") & reduce(lambda c, k: c | fits(k, v), KINDS, F.lit(False))
    rows = rows.withColumn("_runs", F.when(F.col("text").rlike(r"[0-9]\)?[ ]\(?[0-9]"), pieces(F.col("blank"), _RUN, formed)))
    rows = rows.withColumn("_blank", F.when(F.exists("_runs", lambda p: p["ok"]), blanked(F.col("_runs"))).otherwise(F.col("blank")))
    words = F.when(F.col("text").rlike("[0-9@]"), spans(pieces(F.col("_blank"), _WORD, lambda _: F.lit(True)), -1)).otherwise(F.array().cast(SPAN))
    maybe = F.concat(spans(F.col("_runs"), -1), F.filter(F.transform(words, trimmed), lambda s: F.length(s["value"]) > 3))
    return checkpointed(rows.select("doc_id", F.xxhash64("text").alias("mark"), "base", maybe.alias("maybe")))


def learn(found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rows (pattern, kind, share) of the patterns that are believed, from the graph of patterns and values in what ``read`` gives."""
    said = found.select(F.explode(F.concat("base", "maybe")).alias("s")).select(F.explode("s.patterns").alias("pattern"), F.col("s.kind").alias("seed"), F.col("s.value").alias("value"))
    pairs = checkpointed(said.groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    formed = F.array(*[F.count(F.when((F.col("seed") < 0) & fits(k, F.col("value")), 1)) for k in KINDS])
    total = pairs.groupBy("pattern").agg(F.count("*").alias("instances"), formed.alias("formed")).where(F.col("instances") >= support)
    pairs = checkpointed(pairs.join(total, "pattern"))  # no other pattern can have the support
    own = pairs.where("seed >= 0").select("value", F.col("seed").alias("kind")).distinct()
    known, before = checkpointed(own), -1
    while (n := known.count()) != before:
        before = n
        backed = pairs.join(known, "value").where((F.col("seed") == F.col("kind")) | ((F.col("seed") < 0) & fits_kind(F.col("kind"), F.col("value"))))
        backed = backed.groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.count(F.when(F.col("seed") < 0, 1)).alias("new"), F.max("instances").alias("instances"), F.any_value("formed").alias("formed")).where(F.col("n") >= support)
        counted = F.col("instances") - UNKNOWN * (F.get("formed", F.col("kind")) - F.col("new"))
        patterns = checkpointed(backed.select("pattern", "kind", (F.col("n") / counted).alias("share")))
        told = pairs.where("seed < 0").join(patterns, "pattern").where(fits_kind(F.col("kind"), F.col("value")))
        told = told.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("share"), F.lit(1e-9)))))).alias("sure")).where(F.col("sure") >= confidence)
        told = told.join(own.select("value"), "value", "left_anti")
        known = checkpointed(known.unionByName(told.select("value", "kind")).distinct())
    return patterns.where(F.col("share") >= confidence)


def discovered(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, kind, start, end) of unseen identifiers that believed patterns mark; of several kinds the surest."""
    rows = found.select("doc_id", "mark", F.explode("maybe").alias("s")).select("doc_id", "mark", F.explode("s.patterns").alias("pattern"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"))
    rows = rows.join(patterns, "pattern").where(fits_kind(F.col("kind"), F.col("value")))
    return rows.groupBy("doc_id", "mark", "start", "end").agg(F.max_by("kind", F.struct("share", -F.col("kind"))).alias("kind"))


def texts_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_more(found: DataFrame) -> DataFrame:
    """``read``'s rows and the column more: the unseen identifiers of each text."""
    more = discovered(found, learn(found)).groupBy(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark")).agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("more"))
    rows = found.join(more, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")
    return rows.select("doc_id", "mark", "base", F.coalesce("more", F.array().cast(BARE)).alias("more"))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def find(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every document.

    Counts and digest are of the base spans, spans has these and the unseen identifiers:
    kind:start:end by kind, then start, joined by commas; code points, ends exclusive.  A null
    text counts as empty: no spans, counts 0.  A null doc_id stays null; repeated rows each
    give a row; other columns are ignored.
    """
    rows = with_more(read(docs))
    counts = [F.size(F.filter("base", partial(_is_kind, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    base = texts_of(F.col("base"))
    return rows.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), texts_of(F.array_sort(F.concat(_bare(F.col("base")), F.col("more")))).alias("spans"))


def cut_out(blocks: Column, a: Column, b: Column) -> Column:
    """Code points a to b, exclusive, of a text in blocks of _BLOCK."""
    i, j, head, tail = F.shiftright(a, 10), F.shiftright(b, 10), a.bitwiseAND(F.lit(_BLOCK - 1)) + 1, b.bitwiseAND(F.lit(_BLOCK - 1))
    first, last = F.coalesce(F.get(blocks, i), F.lit("")), F.coalesce(F.get(blocks, j), F.lit(""))
    several = F.concat(F.substring(first, head, F.lit(_BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(last, F.lit(1), tail))
    return F.when(a >= b, F.lit("")).when(i == j, F.substring(first, head, b - a)).otherwise(several)


def replaced(text: Column, spans: Column) -> Column:
    """The text with the kind, like ``<email>``, for each span; what overlaps is one span of the first one's kind."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def of(ss: Column) -> Column:
        ends = F.transform(ss, lambda s: -s["minus_end"])

        def joined(before: Column) -> Column:
            heads = F.filter(F.transform(ss, lambda s, i: F.struct(F.get(before, i).alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))), lambda h: h["to"] >= h["from"])
            blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
            kept = lambda b: F.array_join(F.transform(heads, lambda h: F.concat(cut_out(b, h["from"], h["to"]), F.element_at(names, h["kind"] + 1))), "")
            return bound(blocks, lambda b: F.concat(kept(b), cut_out(b, F.array_max(ends), F.length(text))))

        return bound(running(ends, lambda a, b: F.greatest(a, b)), joined)

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind"))))
    return F.when(F.size(spans) > 0, bound(ordered, of)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind, like ``<email>``; spans that overlap are replaced together.  n_chars, if there, follows; other columns are as they were, and so are texts without spans."""
    more = with_more(read(docs)).where(F.size("more") > 0).select(F.col("doc_id").alias("more_id"), F.col("mark").alias("more_mark"), "more").dropDuplicates(["more_id", "more_mark"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    rows = rows.join(more, F.col("doc_id").eqNullSafe(F.col("more_id")) & (F.col("mark") == F.col("more_mark")), "left")
    rows = with_pieces(rows).withColumn("spans", F.concat(_bare(base_spans()), F.coalesce("more", F.array().cast(BARE))))
    rows = rows.withColumn("new", F.when(F.size("spans") > 0, replaced(F.col("text"), F.col("spans"))).otherwise(F.col("row.text").cast("string")))
    out = []
    for c in docs.columns:
        as_was = F.col(f"row.`{c}`")
        out.append(F.col("new").alias(c) if c == "text" else F.when(F.size("spans") > 0, F.length("new").cast("long")).otherwise(as_was).alias(c) if c == "n_chars" else as_was.alias(c))
    return rows.select(*out)
