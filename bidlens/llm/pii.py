"""Personal data by weak supervision; DataFrame functions only.

Patterns propose spans. Regex, gazetteer and context labelers vote on each; expectation-maximisation
over the counts of vote patterns (a bounded table) estimates how reliable each labeler is; a naive Bayes
span classifier is then trained on the resulting probabilities. Base spans always stay; a wider candidate
is added where the classifier takes it for personal data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlens.functions.text import let
from bidlens.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Patterns of base kinds. Possessive loops and the look-behinds only keep matching linear: a match that
#: begins inside a run of its class would also begin at the run's start, or where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider candidates, added only if the classifier agrees.
WIDE = {
    "phone_local": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
}
#: A text without this can't hold a match.
_NEEDS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "phone": r"\+[0-9]",
    "phone_local": r"[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}",
    "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}",
}
#: Words that announce or deny personal data, and known beginnings and ends of it.
CUES = {
    "email": "mail|contact|write|courriel|correo|schreib",
    "ip": "ip|host|server|address|adresse|direcci",
    "card": "card|visa|carte|karte|tarjeta|credit",
    "phone": "phone|tel|call|mobile|fax|appel|anruf|llam",
    "phone_local": "phone|tel|call|mobile|fax|appel|anruf|llam",
    "national_id": "ssn|social|security|national|insee|dni|ausweis",
    "iban": "iban|bank|account|compte|konto|cuenta",
}
DENIALS = "version|isbn|issn|doi|serial|build|figure|page|chapter|invoice|order no"
#: Gazetteers, fixed values: ends of mail domains, calling codes, issuers of cards, lengths of IBANs by country, given names.
MAIL_ENDS = "com org net edu gov info io de fr es uk it eu ch at be nl pt ie pl ru us ca au br jp in"
CALLING_ONE, CALLING_TWO = "1 7", "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
#: Three-digit calling codes by their first two digits.
CALLING_ZONES = "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99"
#: First and last four digits of issuers' ranges.
ISSUERS = ((3000, 3059), (3400, 3499), (3528, 3589), (3600, 3699), (3700, 3799), (3800, 3899), (4000, 4999), (5100, 5599), (2221, 2720), (6011, 6011), (6200, 6299), (6440, 6599))
IBAN_LENGTHS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24}
GIVEN_NAMES = "alice anna anne ben carlos carmen charles claire daniel david elena emily emma eva hans ines isabel jack james jane jean john jose juan julia julie karl laura lea lena louis lucas lucia luis maria marie mark martin mary max michael miguel nina olivia paul pedro peter pierre robert sarah sofia sophie stefan susan thomas tom"
LABELERS = ("regex", "gazetteer", "cue", "denial", "shape")
_END = "end"
#: So many code points before a match, and so many matches of its kind, are looked at for its context.
REACH, PASSED = 40, 20
#: Words before a span are features as numbers of so many buckets.
WORD_BUCKETS = 256


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    value = lambda i: F.ascii(F.substring(F.reverse(digits), i, F.lit(1))) - 48
    doubled = lambda i: F.when(i % 2 == 1, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + doubled(i)) % 10 == 0


def _holds(kind: Column, match: Column) -> Column:
    """Whether a base match meets its kind's condition."""
    digits = _digits(match)
    plain = lambda part: F.regexp_replace(part, "^0+", "")
    small = lambda part: (F.length(plain(part)) <= 3) & (F.lpad(plain(part), 3, "0") <= "255")
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", F.forall(F.split(match, r"\."), small))
        .when(kind == "card", F.length(digits).between(12, 19) & luhn(digits))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(False)
    )


def _listed(words: str, value: Column) -> Column:
    return value.isin(*words.split())


def in_gazetteer(kind: Column, match: Column) -> Column:
    """Whether the kind's list holds the match's domain, private network, issuer, calling code, area or country."""
    digits = _digits(match)
    four, area = F.left(digits, F.lit(4)), F.left(digits, F.lit(3))
    issued = F.greatest(*[four.between(str(low), str(high)) for low, high in ISSUERS])
    country = F.coalesce(*[F.when(F.left(match, F.lit(2)) == code, F.length(match) == size) for code, size in IBAN_LENGTHS.items()], F.lit(False))
    private = match.rlike(r"^(?:0*10|0*127|0*192\.0*168|0*172\.0*(?:1[6-9]|2[0-9]|3[01]))\.")
    return (
        F.when(kind == "email", _listed(MAIL_ENDS, F.lower(F.substring_index(match, ".", -1))))
        .when(kind == "ip", private)
        .when(kind == "card", issued)
        .when(kind == "phone", _listed(CALLING_ONE, F.left(digits, F.lit(1))) | _listed(f"{CALLING_TWO} {CALLING_ZONES}", F.left(digits, F.lit(2))))
        .when(kind == "phone_local", area.rlike("^[2-9]"))
        .when(kind == "national_id", ~area.isin("000", "666") & (area < "900") & ~match.rlike("-00-|-0000$"))
        .when(kind == "iban", country)
    )


def _named(before: Column) -> Column:
    """Whether a given name, with a capital, is among the words."""
    return F.arrays_overlap(F.split(before, r"[^\p{L}]+"), F.array(*[F.lit(name.capitalize()) for name in GIVEN_NAMES.split()]))


def _before(tails: Column, i: Column) -> Column:
    """What stands before match i: `REACH` code points, in which up to `PASSED` earlier matches of the kind count as one # each."""
    own = F.get(tails, i)
    past = F.array_join(F.slice(tails, F.greatest(i - PASSED, F.lit(0)) + 1, F.least(i, F.lit(PASSED)) + 1), "#")
    return F.when(F.length(own) >= REACH, own).otherwise(F.right(past, F.lit(REACH)))


def _proposals(text: Column, kind: str, pattern: str) -> Column:
    """Per match in order: kind, match, length of the text since the last match, what stands before it."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(REACH)).alias("tail")))
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), gaps.alias("g"))

    def placed(x: Column) -> Column:
        sized = F.struct(x["m"].alias("m"), x["g"]["gap"].alias("gap"), x["g"]["tail"].alias("tail"))
        return let(sized, lambda y: F.transform(y["m"], lambda m, i: F.struct(F.lit(kind).alias("kind"), m.alias("match"), F.get(y["gap"], i).alias("gap"), _before(y["tail"], i).alias("before"))))

    there = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_NEEDS[kind])
    return F.when(there, let(found, placed)).otherwise(F.array().cast("array<struct<kind:string,match:string,gap:int,before:string>>"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored rows row, doc_id, kind, match, start, end, before, base; one row of kind `end` closes each document."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    close = F.array(F.struct(F.lit(_END).alias("kind"), F.lit("").alias("match"), F.lit(0).alias("gap"), F.lit("").alias("before")))
    found = F.concat(*[_proposals(F.col("text"), kind, pattern) for kind, pattern in (BASE | WIDE).items()], close)
    every = base.select("row", "doc_id", F.posexplode(found).alias("nth", "found")).select("row", "doc_id", "nth", "found.*")
    # A running sum over a document's matches of one kind gives the offsets.
    so_far = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("match")).over(so_far)
    placed = every.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    holds = placed.withColumn("base", F.col("kind").isin(*KINDS) & _holds(F.col("kind"), F.col("match")))
    return materialize(holds.filter(F.col("base") | ~F.col("kind").isin(*KINDS)).select("row", "doc_id", "kind", "match", "start", "end", "before", "base"), "pii-candidates")


def votes(found: DataFrame) -> DataFrame:
    """One column a labeler: 1 personal, 0 not, null abstains."""
    by_kind = lambda table, col: F.coalesce(*[F.when(F.col("kind") == kind, col.rlike(pattern)) for kind, pattern in table.items()])
    low, digits = F.lower("before"), _digits(F.col("match"))
    return (
        found.filter(F.col("kind") != _END)
        .withColumn("regex", F.when(F.col("base"), 1))
        .withColumn("gazetteer", in_gazetteer(F.col("kind"), F.col("match")).cast("int"))
        .withColumn("cue", F.when(by_kind({k: rf"(?:{v})[^.\n]*$" for k, v in CUES.items()}, low) | _named(F.col("before")), 1))
        .withColumn("denial", F.when(low.rlike(rf"(?:{DENIALS})[^.\n]*$"), 0))
        .withColumn("shape", F.when((F.length(digits) > 5) & digits.rlike(r"^([0-9])\1*$"), 0))
    )


def reliabilities(patterns: list[tuple[dict, int]], rounds: int = 30) -> tuple[dict, dict[str, tuple[float, float]]]:
    """Expectation-maximisation over (votes, count): a prior per kind, and per labeler P(vote 1 | personal), P(vote 1 | not).

    Labelers are independent given the truth and may abstain. The start trusts each labeler at 0.8, and
    counts of one added to either side keep a labeler without votes there.
    """
    prior = {votes["kind"]: 0.5 for votes, _ in patterns}
    trust = {name: (0.8, 0.2) for name in LABELERS}
    for _ in range(rounds):
        sums = {kind: [1.0, 2.0] for kind in prior}
        yes = {name: [0.8, 1.0, 0.2, 1.0] for name in LABELERS}
        for row, count in patterns:
            p = posterior(row, prior, trust)
            sums[row["kind"]][0] += p * count
            sums[row["kind"]][1] += count
            for name in LABELERS:
                if row[name] is not None:
                    yes[name][0] += p * count * row[name]
                    yes[name][1] += p * count
                    yes[name][2] += (1 - p) * count * row[name]
                    yes[name][3] += (1 - p) * count
        prior = {kind: a / b for kind, (a, b) in sums.items()}
        # One-sided labelers only ever vote one way, so their rates stay inside the open interval.
        trust = {name: (min(0.99, max(0.01, a / b)), min(0.99, max(0.01, c / d))) for name, (a, b, c, d) in yes.items()}
    return prior, trust


def posterior(row: dict, prior: dict, trust: dict[str, tuple[float, float]]) -> float:
    odds = math.log(prior[row["kind"]] / (1 - prior[row["kind"]]))
    for name, (if_true, if_false) in trust.items():
        if row[name] is not None:
            odds += math.log(if_true / if_false) if row[name] else math.log((1 - if_true) / (1 - if_false))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def _features(found: DataFrame) -> DataFrame:
    """One array column of a span's features: its shape, the words before it and what its labelers looked at; a bounded set of values."""
    words = F.filter(F.split(F.lower("before"), r"[^\p{L}]+"), lambda w: F.length(w) > 1)
    bucket = lambda back: F.coalesce(F.pmod(F.crc32(F.get(words, F.size(words) - back)), F.lit(WORD_BUCKETS)).cast("string"), F.lit("-"))
    shape = F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace("match", "[A-Za-z]+", "a"), "[0-9]+", "0"), r"\s", "_"), 1, 12)
    known = F.when(shape.rlike(r"^[a0._()@+-]{1,8}$"), shape).otherwise("long")
    parts = {
        "kind": F.col("kind"),
        "size": F.least(F.length("match"), F.lit(40)).cast("string"),
        "shape": known,
        "named": _named(F.col("before")).cast("string"),
        "word": bucket(1),
        "word_before": bucket(2),
        "left": F.when(F.col("before") == "", "start").when(F.col("before").rlike(r"\s$"), "blank").when(F.col("before").rlike(r"[:=]$"), "colon").otherwise("other"),
        **{name: F.coalesce(F.col(name).cast("string"), F.lit("-")) for name in LABELERS[1:]},
    }
    return found.withColumn("features", F.array(*[F.concat(F.lit(f"{name}="), value) for name, value in parts.items()]))


def train(voted: DataFrame) -> dict[str, float]:
    """Log-odds by feature (and the intercept under ''); only bounded counts come to the driver."""
    counted = voted.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = [({name: row[name] for name in ("kind", *LABELERS)}, row["n"]) for row in counted]
    if not patterns:
        return {}
    prior, trust = reliabilities(patterns)
    truth = F.lit(0.0)
    for name, (if_true, if_false) in trust.items():
        truth += F.when(F.col(name) == 1, math.log(if_true / if_false)).when(F.col(name) == 0, math.log((1 - if_true) / (1 - if_false))).otherwise(0.0)
    for kind, share in prior.items():
        truth += F.when(F.col("kind") == kind, math.log(share / (1 - share))).otherwise(0.0)
    soft = _features(voted).withColumn("p", 1 / (1 + F.exp(-truth)))
    sums = soft.select("p", F.explode(F.concat("features", F.array(F.lit("")))).alias("feature")).groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    total = next(row for row in sums if row["feature"] == "")
    base = math.log((total["yes"] + 1) / (total["no"] + 1))
    return {row["feature"]: base if row["feature"] == "" else math.log((row["yes"] + 1) / (row["no"] + 1)) - base for row in sums}


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, n_added, spans.

    Null and empty texts have no spans. Repeated rows and null ids get a row each, an empty table none;
    other columns are not read. Offsets are code points, end exclusive. Added spans have kinds of their
    own (phone_local, national_id, iban), come after base kinds of the same start, and are left out where
    a base span overlaps them.
    """
    found = candidates(docs, id_col, text_col)
    voted = votes(found)
    weights = train(voted)
    score = F.lit(weights.get("", 0.0))
    if weights:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        score += F.aggregate("features", F.lit(0.0), lambda total, name: total + F.coalesce(F.try_element_at(table, name), F.lit(0.0)))
    judged = _features(voted).withColumn("taken", F.col("base") | (1 / (1 + F.exp(-score)) >= threshold)).filter("taken")
    # Of wide spans, those that overlap a base span say nothing new: spans in order, against the furthest base end so far and the next base start.
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    far = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    near = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    apart = F.coalesce(far <= F.col("start"), F.lit(True)) & F.coalesce(near >= F.col("end"), F.lit(True))
    kept = judged.withColumn("apart", apart).filter("base or apart")
    rank = F.array_position(F.array(*[F.lit(kind) for kind in (*KINDS, *WIDE)]), F.col("kind"))
    spans = kept.select("row", "kind", "base", F.struct("start", rank.alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("text")).alias("span"))
    listed = lambda spans: F.array_join(F.transform(F.sort_array(spans), lambda s: s["text"]), ",")
    per_row = spans.groupBy("row").agg(
        *[F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(F.collect_list(F.when(F.col("base"), F.col("span")))), 256).alias("base_sha256"),
        F.count_if(~F.col("base")).alias("n_added"),
        listed(F.collect_list("span")).alias("spans"),
    )
    rows = found.filter(F.col("kind") == _END).select("row", "doc_id")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return rows.join(per_row, "row", "left").select(
        "doc_id",
        *[zero(f"n_{kind}") for kind in KINDS],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        zero("n_added"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
