"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Every candidate span gets three votes: a *regex* labeler (a stricter shape), a
*gazetteer* labeler (known domains, issuers, calling codes, reserved ranges) and
a *context* labeler (a cue word in front). A labeler may abstain. Expectation
maximisation over the counts of all vote patterns estimates each labeler's
reliability for each kind without labels; the posteriors then train a naive Bayes
span classifier on the votes and on features no labeler sees (digit count, length,
separators, what stands in front), which decides on the looser candidates. Spans
of the four base kinds always stay.

Only the counts of patterns (kinds x votes x small buckets: a fixed number,
whatever the input) reach the driver; candidates never leave their rows. Very
long texts are scanned whole; a text of many spans costs in proportion to them.

Defined results: a null text counts as empty and has no spans; a null or
repeated id is carried through; there are no ties: spans are listed by start, then
kind, and of two that share a character the base one stays; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .spans import clear_of, find_spans, listing

KINDS = ["email", "ip", "card", "phone"]

#: The base patterns. Look-behinds and possessive repeats only keep long runs linear, and
#: groups of any number of repeats free of recursion: what is repeated and what ends it share no character.
#: a match can start inside a run of its own first characters only right after the match before it.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Looser shapes, which the classifier decides on.
LOOSE_EMAIL = (
    r"[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,63}){1,4}"
    r"|\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20dot\x20[A-Za-z0-9-]{1,63}){1,4})"
)
LOOSE_IP = (
    r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"
)
LOOSE_CARD = r"(?<![0-9.+-])[0-9]{4}(?:\x20{0,2}[./\x20-]\x20{0,2}[0-9]{2,7}){2,4}(?![0-9])"
LOOSE_PHONE = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20.-][0-9]{2,5}){2,4}(?![0-9A-Za-z.-])"

#: Gazetteers and cue words.
DOMAINS = ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "it", "eu", "ch", "at"]
CODES = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49",
         "52", "54", "55", "61", "62", "64", "65", "81", "82", "86", "90", "91"]
CUES = {
    "email": ["mail", "contact", "write", "escrib", "kontakt"],
    "ip": ["ip", "addr", "server", "host", "login"],
    "card": ["card", "visa", "pay", "karte", "carte", "tarjeta"],
    "phone": ["tel", "phone", "call", "fax", "mobil", "ring", "contact"],
}


@dataclass(frozen=True)
class Labels:
    """Column builders: a vote is 1, 0 or null (abstains)."""

    kind: str

    def digits(self, hit: Column) -> Column:
        return F.regexp_replace(hit, "[^0-9]", "")

    def plain(self, hit: Column) -> Column:
        """A looser shape as it is meant: ``a (at) b (dot) org`` as ``a@b.org``, a card's digits alone."""
        if self.kind == "email":
            at = F.regexp_replace(hit, r"\x20?[\[(]at[\])]\x20?|\x20at\x20", "@")
            return F.regexp_replace(F.regexp_replace(at, r"\x20?[\[(]dot[\])]\x20?|\x20dot\x20", "."), r"\x20", "")
        return F.regexp_replace(hit, r"(?<=[0-9])[./\x20-]+(?=[0-9])", "") if self.kind == "card" else hit

    def regex(self, hit: Column) -> Column:
        hit = self.plain(hit)
        shape = {
            "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9][A-Za-z0-9-]*+\.)++[A-Za-z]{2,24}$",
            "ip": r"^(?:(?=.*:)(?=(?:.*[0-9]){2})(?:[0-9A-Fa-f]{1,4}:?){1,8}(?::(?:[0-9A-Fa-f]{1,4}:?){1,8})?|(?:[1-9]?[0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.(?:[1-9]?[0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3})$",
            "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$",
            "phone": r"^(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{1,5}\)|[0-9]{1,5})(?:[\x20.-]?[0-9]{2,5}){1,5}$",
        }[self.kind]
        return hit.rlike(shape).cast("int")

    def gazetteer(self, hit: Column) -> Column:
        hit = self.plain(hit)
        digits = self.digits(hit)
        if self.kind == "email":
            return F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1)).isin(DOMAINS).cast("int")
        if self.kind == "ip":
            known = F.when(hit.contains(":"), hit.rlike(r"^[23][0-9A-Fa-f]{3}:")).otherwise(~hit.rlike(r"^(?:0|10|127|255|192\.168|169\.254)\."))
            return known.cast("int")
        if self.kind == "card":
            return digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|36|6011|65)").cast("int")
        known = reduce(lambda a, b: a | b, [digits.startswith(c) for c in CODES])
        return F.when(hit.startswith("+"), known.cast("int"))

    def context(self, before: Column) -> Column:
        low = F.lower(before)
        return F.when(reduce(lambda a, b: a | b, [low.contains(c) for c in CUES[self.kind]]), F.lit(1))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check-digit rule."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda c: F.expr("0") + F.try_to_number(c, F.lit("9")).cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the four base kinds; matches that fail a kind's test are dropped without another try."""
    lab = {k: Labels(k) for k in KINDS}
    small = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"

    def card_ok(s):
        digits = lab["card"].digits(s["hit"])
        return F.char_length(digits).between(14, 19) & luhn(digits)

    return {
        "email": F.when(text.contains("@"), find_spans(text, EMAIL)),
        "ip": F.filter(find_spans(text, IP), lambda s: s["hit"].rlike(small)),
        "card": F.filter(find_spans(text, CARD), card_ok),
        "phone": F.when(
            text.contains("+"),
            F.filter(find_spans(text, PHONE), lambda s: F.char_length(lab["phone"].digits(s["hit"])).between(10, 15)),
        ),
    }


def loose_spans(text: Column) -> dict[str, Column]:
    low, card = F.lower(text), Labels("card")
    numbers = lambda s: card.digits(s["hit"])
    return {
        "email": F.when(low.contains("at)") | low.contains("at]") | low.contains(" dot "), find_spans(text, LOOSE_EMAIL)),
        "ip": F.when(text.contains(":"), find_spans(text, LOOSE_IP)),
        "card": F.filter(find_spans(text, LOOSE_CARD), lambda s: F.char_length(numbers(s)).between(13, 19) & luhn(numbers(s))),
        "phone": F.filter(
            find_spans(text, LOOSE_PHONE), lambda s: F.char_length(Labels("phone").digits(s["hit"])).between(9, 12)
        ),
    }


def _with_votes(spans: Column, kind: str, base: bool) -> Column:
    lab = Labels(kind)
    none = F.array().cast("array<struct<start:long,kind:int,end:long,base:boolean,feature:string>>")

    def one(s):
        votes = [lab.regex(s["hit"]), lab.gazetteer(s["hit"]), lab.context(s["before"])]
        digits = F.least(F.floor(F.char_length(lab.digits(s["hit"])) / 2), F.lit(10))
        length = F.least(F.floor((s["end"] - s["start"]) / 8), F.lit(5))
        gaps = F.least(F.char_length(F.regexp_replace(s["hit"], "[A-Za-z0-9]", "")), F.lit(6))
        last = F.right(s["before"], F.lit(1))
        front = F.when(last == "", "start").when(last == " ", "space").when(last.rlike("[0-9]"), "digit").when(last.rlike("[A-Za-z]"), "letter")
        front = front.when(last.rlike(r"\s"), "line").otherwise("mark")
        own = [digits.cast("string"), length.cast("string"), gaps.cast("string"), front]
        feature = F.concat_ws("|", F.lit(kind), *[F.coalesce(v.cast("string"), F.lit("-")) for v in votes], *own)
        return F.struct(
            s["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            s["end"].alias("end"),
            F.lit(base).alias("base"),
            feature.alias("feature"),
        )

    return F.coalesce(F.transform(spans, one), none)


def estimate(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], dict[str, list[dict[str, float]]]]:
    """EM over feature counts: each feature's posterior of being personal data, and the labelers' reliabilities by kind.

    The labelers are taken as independent given the truth; an abstention says
    nothing. Labelers start as mostly right, which fixes what the classes mean.
    """
    post, reliabilities = {}, {}
    for kind in {f.split("|", 1)[0] for f in counts}:
        rows = [(f, f.split("|")[1:4], n) for f, n in counts.items() if f.startswith(kind + "|")]
        good = [{"1": 0.8, "0": 0.2} for _ in range(3)]
        bad = [{"1": 0.3, "0": 0.7} for _ in range(3)]
        prior = 0.5
        for _ in range(rounds):
            sums = [[defaultdict(float), defaultdict(float)] for _ in range(3)]
            mass = total = 0.0
            for f, votes, n in rows:
                a, b = math.log(prior), math.log(1 - prior)
                for k, v in enumerate(votes):
                    if v != "-":
                        a, b = a + math.log(good[k][v]), b + math.log(bad[k][v])
                p = post[f] = 1 / (1 + math.exp(max(-60.0, min(60.0, b - a))))
                mass, total = mass + n * p, total + n
                for k, v in enumerate(votes):
                    if v != "-":
                        sums[k][0][v] += n * p
                        sums[k][1][v] += n * (1 - p)
            prior = min(0.99, max(0.01, (mass + 1) / (total + 2)))
            for k in range(3):
                for table, seen in ((good[k], sums[k][0]), (bad[k], sums[k][1])):
                    both = seen["0"] + seen["1"] + 2
                    table.update({v: (seen[v] + 1) / both for v in ("0", "1")})
        reliabilities[kind] = [{"sensitivity": good[k]["1"], "false_alarms": bad[k]["1"]} for k in range(3)]
    return post, reliabilities


def train_classifier(counts: dict[str, int], posterior: dict[str, float]) -> dict[str, float]:
    """Naive Bayes by kind on the posteriors: the log-odds of each feature string."""
    sums: dict[tuple, list[float]] = defaultdict(lambda: [1.0, 1.0])
    whole: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
    for f, n in counts.items():
        p = posterior[f]
        kind, *rest = f.split("|")
        for cell in (whole[kind], *[sums[kind, place, v] for place, v in enumerate(rest)]):
            cell[0] += n * p
            cell[1] += n * (1 - p)

    def odds(f: str) -> float:
        kind, *rest = f.split("|")
        out = math.log(whole[kind][0] / whole[kind][1])
        for place, v in enumerate(rest):
            if v != "-":
                a, b = sums[kind, place, v]
                out += math.log(a / whole[kind][0]) - math.log(b / whole[kind][1])
        return out

    return {f: odds(f) for f in counts}


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``id_col``, ``spans``: array<struct<start,kind,end,base,feature>> of base and accepted spans."""
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col("text"), F.lit(""))
    base, loose = base_spans(text), loose_spans(text)
    parts = [_with_votes(c, k, True) for k, c in base.items()] + [_with_votes(c, k, False) for k, c in loose.items()]
    rows = scratch.keep(
        docs.select(F.col(id_col), F.col(text_col).alias("text")).select(id_col, F.concat(*parts).alias("spans")), "candidates"
    )
    features = rows.select(F.explode("spans").alias("s")).groupBy(F.col("s.feature").alias("feature")).count()
    counts = {r["feature"]: r["count"] for r in features.collect()}  # a fixed number of patterns at most
    posterior, _ = estimate(counts)
    accepted = [f for f, o in train_classifier(counts, posterior).items() if o >= math.log(least / (1 - least))]
    likely = F.filter("spans", lambda s: ~s["base"] & s["feature"].isin(accepted))
    rows = rows.select(id_col, F.filter("spans", lambda s: s["base"]).alias("spans"), likely.alias("likely"))
    return rows.select(id_col, F.concat("spans", clear_of(F.col("likely"), F.col("spans"))).alias("spans"))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    plain = lambda spans: F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    )
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(listing(plain(base), KINDS), 256).alias("base_sha256"),
        listing(plain(F.col("spans")), KINDS).alias("spans"),
    )
