"""Retrieval: keyword occurrences, widened to intervals, merged where they overlap, cut out, ranked, capped.

A tender's text is one row, so all of it happens inside that row's arrays: no shuffle. Texts without a
keyword of a section skip its positional search.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidlens.functions.text import count_hits, find_all, find_word, let, normalize_for_search, quoted, running_max, strip
from bidlens.rules import SCORED_TWICE, SECTIONS_BASIC, SECTIONS_EVIDENCE, SECTIONS_RANKED, SECTIONS_SCORED


def cased(text: Column) -> Column:
    """(low, same): the text in lower case, which takes as long as all else in a search, and whether it is as long as the text."""
    return let(F.lower(text), lambda low: F.struct(low.alias("low"), (F.length(low) == F.length(text)).alias("same")))


def keyword_hits(text: Column, keywords: list[str], lower: Column | None = None) -> Column:
    """Array of (start, end, nth, keyword): all occurrences of all keywords in any case, by start, then list order. `lower` is cased() of the text where a row has it already."""
    # A letter whose lower case is longer would shift what follows; then the text itself is searched.
    hits = lambda x: _hits(text, x["low"], x["same"], keywords)
    return let(cased(text), hits) if lower is None else hits(lower)


def _hits(text: Column, low: Column, same: Column, keywords: list[str]) -> Column:
    named = F.array(*[F.struct(F.lit(n).alias("nth"), F.lit(word).alias("keyword"), F.lit(quoted(word)).alias("pattern")) for n, word in enumerate(keywords)])

    def of(k: Column) -> Column:
        starts = F.when(same, find_word(low, k["keyword"])).otherwise(F.transform(find_all(text, k["pattern"]), lambda m: m["start"]))
        return F.transform(starts, lambda at: F.struct(at.alias("start"), (at + F.length(k["keyword"])).alias("end"), k["nth"].alias("nth"), k["keyword"].alias("keyword")))

    there = F.filter(named, lambda k: F.contains(low, k["keyword"]))
    return F.array_sort(F.flatten(F.transform(there, of)))


def merge_windows(hits: Column, size: Column, window: int, order: str = "nth") -> Column:
    """Gaps and islands in a row: array of (lo, hi, keyword, hits) of the intervals around hits, merged where they touch.

    `keyword` is that of the first hit by start and then by `order` (nth: list order; keyword: alphabet).
    """
    # The length of the text takes a pass over it, so it is worked out once, not for each hit.
    wide = lambda n: F.transform(hits, lambda h: F.struct(F.greatest(F.lit(0), h["start"] - window).alias("lo"), h["start"].alias("start"), h["end"].alias("end"), h[order].alias("order"), F.least(n, h["end"] + window).alias("hi"), h["keyword"].alias("keyword")))

    def islands(w: Column) -> Column:
        far = running_max(F.transform(w, lambda h: h["hi"]))
        fresh = F.filter(F.zip_with(F.transform(w, lambda h, i: F.struct(h["lo"].alias("lo"), i.alias("i"))), far, lambda h, reach: F.when(h["lo"] > reach, h["i"])), lambda i: i.isNotNull())
        return let(fresh, lambda first: F.transform(first, lambda i, n: joined(F.slice(w, i + 1, F.coalesce(F.get(first, n + 1), F.size(w)) - i))))

    def joined(part: Column) -> Column:
        return let(part, lambda p: F.struct(F.get(p, F.lit(0))["lo"].alias("lo"), F.array_max(F.transform(p, lambda h: h["hi"])).alias("hi"), F.get(p, F.lit(0))["keyword"].alias("keyword"), F.transform(p, lambda h: h["keyword"]).alias("found")))

    return let(F.array_sort(let(size, wide)), islands)


def cut_out(text: Column, windows: Column) -> Column:
    """Array of (offset, snippet, keyword, found): stripped pieces; the offset is that of the stripped text."""
    raw = F.transform(windows, lambda w: F.struct(w["lo"].alias("lo"), F.substring(text, w["lo"] + 1, w["hi"] - w["lo"]).alias("raw"), w["keyword"].alias("keyword"), w["found"].alias("found")))
    lead = lambda t: F.length(t) - F.length(F.regexp_replace(t, r"(?U)^\s+", ""))
    pieces = F.transform(raw, lambda w: F.struct((w["lo"] + lead(w["raw"])).alias("offset"), strip(w["raw"]).alias("snippet"), w["keyword"].alias("keyword"), w["found"].alias("found")))
    return F.filter(pieces, lambda p: p["snippet"] != "")


def basic_snippets(text: Column, section: str, window: int = 700, most: int = 6, lower: Column | None = None) -> Column:
    """The first `most` merged windows of normalised text."""
    hits = keyword_hits(text, SECTIONS_BASIC[section], lower)
    return cut_out(text, F.slice(merge_windows(hits, F.length(text), window), 1, most))


def ranked_snippets(text: Column, section: str, window: int = 350, most: int = 8, lower: Column | None = None) -> Column:
    """The windows with most keyword hits, by offset again."""
    words = SECTIONS_RANKED[section]
    pieces = cut_out(text, merge_windows(keyword_hits(text, words, lower), F.length(text), window, "keyword"))
    scored = F.transform(pieces, lambda p: F.struct((-count_hits(F.lower(p["snippet"]), words)).alias("rank"), p["offset"].alias("offset"), p["snippet"].alias("snippet"), p["keyword"].alias("keyword"), p["found"].alias("found")))
    best = F.slice(F.array_sort(scored), 1, most)
    return F.array_sort(F.transform(best, lambda p: F.struct(p["offset"].alias("offset"), p["snippet"].alias("snippet"), p["keyword"].alias("keyword"), p["found"].alias("found"))))


def evidence_snippets(text: Column, section: str, window: int = 800, most: int = 10, lower: Column | None = None) -> Column:
    """The first `most` merged windows, hits by offset, then keyword."""
    hits = keyword_hits(text, SECTIONS_EVIDENCE[section], lower)
    return cut_out(text, F.slice(merge_windows(hits, F.length(text), window, "keyword"), 1, most))


def keyword_weight(word: str) -> float:
    """R5."""
    return 2.2 if " " in word else 2.0 if "/" in word else 1.5 if len(word) >= 8 else 1.0


def scored_snippets(text: Column, section: str, window: int = 900, most: int = 10) -> Column:
    """Windows of the search-normalised text by score: keyword weights, and bonuses for anchors and variety."""
    return let(normalize_for_search(text), lambda low: _scored(low, SECTIONS_SCORED[section], window, most))


def _scored(low: Column, words: list[str], window: int, most: int) -> Column:
    windows = merge_windows(keyword_hits(low, words), F.length(low), window, "keyword")
    weights = {word: keyword_weight(word) * (2 if word in SCORED_TWICE else 1) for word in words}

    def score(found: Column) -> Column:
        total = F.lit(0.0)
        for word, weight in weights.items():
            total = total + (F.size(found) - F.size(F.array_remove(found, word))) * F.lit(weight)
        anchors = lambda distinct: F.size(F.filter(distinct, lambda w: F.contains(w, F.lit(" ")) | F.contains(w, F.lit("/")) | (F.length(w) >= 10)))
        return let(F.array_distinct(found), lambda d: F.round(total + F.least(F.lit(6.0), anchors(d) * F.lit(1.5)) + F.when(F.size(d) >= 3, 1.0).otherwise(0.0), 4))

    scored = F.transform(windows, lambda w: F.struct((-score(w["found"])).alias("rank"), w["lo"].alias("offset"), strip(F.substring(low, w["lo"] + 1, w["hi"] - w["lo"])).alias("snippet"), F.array_sort(F.array_distinct(w["found"])).alias("keywords")))
    best = F.slice(F.array_sort(F.filter(scored, lambda s: s["snippet"] != "")), 1, most)
    return F.transform(best, lambda s: F.struct(s["offset"].alias("offset"), s["snippet"].alias("snippet"), (-s["rank"]).alias("score"), s["keywords"].alias("keywords")))


def context(text: Column, sections: tuple[str, ...] = ("price", "payment", "liability", "execution"), cap: int = 20_000, window: int = 900, most: int = 10) -> Column:
    """Headers and numbered snippets of all sections while they fit; the first that doesn't is cut to the room left, and ends it. The cap is 1000 at least."""
    return let(normalize_for_search(text), lambda low: _context(low, sections, max(1_000, cap), window, most))


def _context(low: Column, sections: tuple[str, ...], cap: int, window: int, most: int) -> Column:
    state = lambda text, full: F.struct(text.alias("text"), full.alias("full"))
    yes, no = F.lit(True), F.lit(False)

    def add(acc: Column, s: Column) -> Column:
        block = F.format_string("[SNIPPET %d | score=%.2f | offset=%d]\n%s\n\n", s["n"], s["score"], s["offset"], s["snippet"])
        room = cap - F.length(acc["text"])
        prefix = F.format_string("[SNIPPET %d]\n", s["n"])
        part = F.concat(prefix, F.regexp_replace(F.left(s["snippet"], room - F.length(prefix) - 1), r"(?U)\s+$", ""), F.lit("\n"))
        cut = F.when(room <= F.length(prefix), acc["text"]).otherwise(F.concat(acc["text"], part))
        whole = lambda b: F.when(F.length(b) <= room, state(F.concat(acc["text"], b), no)).otherwise(state(cut, yes))
        return F.when(acc["full"], acc).otherwise(let(block, whole))

    def section(total: Column, name: str) -> Column:
        header = f"### SECTION: {name.upper()}\n"

        def fill(x: Column) -> Column:
            t, snippets = x["t"], x["s"]
            fits = F.length(t["text"]) + len(header) <= cap
            begun = F.when(t["full"] | (F.size(snippets) == 0), t).when(fits, state(F.concat(t["text"], F.lit(header)), no)).otherwise(state(t["text"], yes))
            numbered = F.transform(snippets, lambda s, i: F.struct((i + 1).alias("n"), s["snippet"].alias("snippet"), s["score"].alias("score"), s["offset"].alias("offset")))
            return F.aggregate(numbered, begun, add)

        return let(F.struct(total.alias("t"), _scored(low, SECTIONS_SCORED[name], window, most).alias("s")), fill)

    total = state(F.lit(""), no)
    for name in sections:
        total = section(total, name)
    return strip(total["text"])
