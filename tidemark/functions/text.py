"""Text functions as Column expressions: cleaning, fingerprints, cues, lexicon sentiment, hashing."""

from __future__ import annotations

import html.entities
import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of HTML entities and what they stand for, as the standard has them; those without a semicolon are read as far as they go.
NAMED = {k: v for k, v in html.entities.html5.items() if k.endswith(";")}
LEGACY = {k: v for k, v in html.entities.html5.items() if not k.endswith(";")}
#: Numbers that the standard reads as characters of an old code page.
_SILENT = [*range(0x1, 0x9), 0xB, *range(0xE, 0x20), 0x7F, *range(0xFDD0, 0xFDF0), *[plane << 16 | x for plane in range(17) for x in (0xFFFE, 0xFFFF)]]
OLD_NUMBERS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
# Patterns and words of the cleaning rules.
URL = r"https?://\S+|www\.\S+"
RETWEET = r"(?i)^\s*RT @\w+:\s*"
PUBLISHER_SUFFIX = r"(?U)\s+[-|–—]\s+[A-Z][\w&.' ]{1,30}$"
FILE_NAME = r"(?iU)^[\w\s().,&'-]{1,80}\.(pdf|docx?|xlsx?|pptx?|csv|txt)$"
#: Words that no complete headline ends in; fixed values.
OPEN_ENDINGS = ["a", "an", "the", "of", "to", "amid", "with", "by", "from", "into", "for", "and", "or", "but", "as", "at", "its", "their", "his", "her", "than"]


def unescape(text: Column) -> Column:
    """HTML entities resolved, named ones and numbers, as browsers do; null stays null.

    Only texts with an ampersand are cut at these; a name is looked up among the standard's.
    """
    named, legacy, old = (F.from_json(F.lit(json.dumps(d)), "map<string,string>") for d in (NAMED, LEGACY, OLD_NUMBERS))
    longest = max(map(len, LEGACY))

    def number(ref: Column) -> Column:
        hexed = F.lower(F.substring(ref, 2, 1)) == "x"
        digits = F.regexp_replace(F.regexp_replace(ref, "^#[xX]?", ""), "^0+(?=.)", "")
        n = F.when(F.length(digits) > 7, F.lit(1 << 30)).otherwise(F.when(hexed, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("int"))
        bad, silent = (n > 0x10FFFF) | n.between(0xD800, 0xDFFF) | (n == 0), n.isin(*_SILENT)
        return F.when(bad, "\ufffd").when(n.between(0x80, 0x9F), old[n.cast("string")]).when(n == 0x0D, "\r").when(silent, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def one(piece: Column) -> Column:
        ref = F.regexp_extract(piece, r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", 1)
        bare = F.regexp_replace(ref, ";$", "")
        size = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(longest)), lambda k: F.when(legacy[F.substring(ref, F.lit(1), k)].isNotNull() & (k <= F.length(ref)), k).otherwise(0)))
        rest = F.substring(piece, F.length(ref) + 1, F.length(piece))
        name = F.when(named[ref].isNotNull(), F.concat(named[ref], rest)).when(size > 0, F.concat(legacy[F.substring(ref, F.lit(1), size)], F.substring(piece, size + 1, F.length(piece)))).otherwise(F.concat(F.lit("&"), piece))
        return F.when(ref == "", F.concat(F.lit("&"), piece)).when(ref.startswith("#"), F.concat(_of(bare, number), rest)).otherwise(name)

    def resolved(t: Column) -> Column:
        return bound(F.split(t, "&", -1), lambda ps: F.concat(F.get(ps, F.lit(0)), F.array_join(F.transform(F.slice(ps, 2, F.size(ps)), one), "")))

    return F.when(text.contains("&"), resolved(text)).otherwise(text)


def _of(value: Column, body) -> Column:
    return body(value)


def unescape_only(text: Column, entities: list[tuple[str, str]]) -> Column:
    """The entities given resolved one after another, as they are written, and no others."""
    return F.when(text.contains("&"), reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), entities, text)).otherwise(text)


def clean_text(text: Column, strip_publisher: bool = False, entities: list[tuple[str, str]] | None = None) -> Column:
    """Entities resolved (all, or those given), links and a leading retweet mark dropped, white space collapsed, and on request a trailing publisher name cut."""
    text = F.coalesce(text, F.lit(""))
    out = F.regexp_replace(F.regexp_replace(unescape(text) if entities is None else unescape_only(text, entities), URL, " "), RETWEET, "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.regexp_replace(out, PUBLISHER_SUFFIX, "") if strip_publisher else out


def fingerprint(text: Column, entities: list[tuple[str, str]] | None = None) -> Column:
    """MD5 of the cleaned text in lower case with everything but a-z, 0-9 and $ reduced to single spaces."""
    return F.md5(F.trim(F.regexp_replace(F.lower(clean_text(text, entities=entities)), "[^a-z0-9$]+", " ")))


def is_file_name(text: Column) -> Column:
    return F.trim(text).rlike(FILE_NAME)


def tidy_headline(text: Column) -> Column:
    """The longest part between bars if it has 25 characters or more, and an ellipsis where a title of over three words was cut off."""
    parts = F.filter(F.transform(F.split(text, r" \| "), lambda p: F.trim(p)), lambda p: p != "")
    best = F.aggregate(parts, F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    return marked_if_cut(F.when(F.contains(text, F.lit(" | ")) & (F.length(best) >= 25), best).otherwise(text))


def marked_if_cut(title: Column) -> Column:
    """A title with an ellipsis where it has over three words and ends in one that no complete one ends in."""
    words = F.split(F.rtrim(title), " ")
    cut = (F.size(words) > 3) & F.lower(F.element_at(words, -1)).isin(OPEN_ENDINGS)
    return F.when(cut, F.concat(F.rtrim(title), F.lit("…"))).otherwise(title)


def hash_share(text: Column, salt: str = "") -> Column:
    """A number from 0 to 1 that depends on the trimmed, lower-cased text alone, for splits that stay put."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.lower(F.trim(text)))), 1, 8), 16, 10).cast("double") / 4294967295.0


def split_name(text: Column, test_share: float = 0.2, dev_share: float = 0.1) -> Column:
    """test, dev or train: the first by the text's share, the second by a salted share of the rest."""
    return F.when(hash_share(text) < test_share, "test").when(hash_share(text, "dev|") < dev_share, "dev").otherwise("train")


def make_id(*parts: Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-1 of the parts, joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, length)


def bound(value: Column, body) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))


def lexicon_sentiment(text: Column, positive: list[str], negative: list[str], negators: list[str]) -> Column:
    """A struct (neg, neu, pos) of shares.

    A word counts for the other side if a negator, or a word in n't, is among the three
    before it.  Three hits give the full strength of 0.8; none give (0.1, 0.8, 0.1).
    """
    def scored(words: Column) -> Column:
        flipped = lambda i: F.exists(F.slice(words, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), lambda w: w.isin(negators) | w.endswith("n't"))
        return F.transform(words, lambda w, i: F.when(w.isin(positive), F.when(flipped(i), -1).otherwise(1)).when(w.isin(negative), F.when(flipped(i), 1).otherwise(-1)).otherwise(0))

    def shares(polarity: Column) -> Column:
        pos, neg = F.size(F.filter(polarity, lambda p: p > 0)), F.size(F.filter(polarity, lambda p: p < 0))
        return F.struct(pos.alias("pos"), neg.alias("neg"))

    return bound(bound(bound(tokens(F.coalesce(text, F.lit(""))), scored), shares), sentiment_of)


def sentiment_of(n: Column) -> Column:
    """A struct (neg, neu, pos) of shares from a struct (pos, neg) of hits."""
    hits = n["pos"] + n["neg"]
    strength = F.least(F.lit(1.0), hits / 3.0) * 0.8
    side = lambda k: F.when(hits == 0, 0.1).otherwise(0.1 + strength * k / hits - 0.1 * strength / 0.8)
    return F.struct(side(n["neg"]).alias("neg"), (1 - side(n["pos"]) - side(n["neg"])).alias("neu"), side(n["pos"]).alias("pos"))


def cue_counts(text: Column, cues: dict[str, list[str]]) -> Column:
    """A map from each type to how many of its patterns (not how many matches) occur, case ignored."""
    pairs = []
    for name, patterns in cues.items():
        pairs += [F.lit(name), reduce(lambda a, b: a + b, [text.rlike("(?i)" + p).cast("int") for p in patterns], F.lit(0))]
    return F.create_map(*pairs)


def cue_occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit("(?i)" + pattern))


def best_type(counts: Column, order: list[str]) -> Column:
    """The type of most cues, the first in order among equals; null without any."""
    ranked = F.array(*[F.struct(counts[name].alias("n"), F.lit(-i).alias("rank"), F.lit(name).alias("name")) for i, name in enumerate(order)])
    top = F.array_max(ranked)
    return F.when(top["n"] > 0, top["name"])


def excerpt(text: Column, target: str, length: int = 280) -> Column:
    """The first sentence that matches target, or else the first, cut to length."""
    sentences = F.split(text, r"(?<=[.!?])\s+")
    hit = F.filter(sentences, lambda s: s.rlike(target))
    return F.substring(F.when(F.size(hit) > 0, hit[0]).otherwise(sentences[0]), 1, length)


def mentioned(text: Column, aliases: dict[str, list[str]], case_sensitive: bool = False) -> Column:
    """Distinct ids whose aliases occur as whole words, in the order of the dictionary."""
    mark = "" if case_sensitive else "(?i)"

    def any_of(names: list[str]) -> str:
        longest = sorted(names, key=lambda a: (-len(a), a))
        return mark + "(?<![A-Za-z0-9])(" + "|".join(a.replace(".", r"\.").replace("$", r"\$") for a in longest) + ")(?![A-Za-z0-9])"

    return F.array_compact(F.array(*[F.when(text.rlike(any_of(names)), F.lit(i)) for i, names in aliases.items()]))


def money(amount: Column) -> Column:
    """Like $1.2bn, $35.0m or $900."""
    size = F.abs(amount)
    sign = F.when(amount < 0, "-").otherwise("")
    return F.when(size >= 1e9, F.format_string("%s$%.1fbn", sign, size / 1e9)).when(size >= 1e6, F.format_string("%s$%.1fm", sign, size / 1e6)).otherwise(F.format_string("%s$%.0f", sign, size))


def dollars(text: Column) -> Column:
    """A number from text like $-1,234.50; null where it is none."""
    return F.regexp_replace(text, "[$,]", "").try_cast("double")
