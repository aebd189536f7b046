"""Personal data by weak supervision, in Spark expressions only.

Patterns propose spans; labelers vote on each: its format, a gazetteer, its context and its shape.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is for each
kind, without labels. Its posteriors train the span classifier, a naive Bayes model over votes, length and
surroundings, that decides on every proposal beyond the base spans.

What comes to the driver are counts by kind, votes and features: the values of each are fixed, so their
number does not grow with the input.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnforge.llm import common

#: Base kinds in the order that breaks ties, then those that only the method proposes.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "ssn", "iban", "name")
#: Kinds whose format is a checksum or a range: that one of them is real but fails it is known to be this rare, not estimated.
CHECKED, MISSED = ("card", "ip"), 1e-4

# Possessive and anchored forms of the base patterns: the same matches, in linear time and constant stack.
# A match of email or ip starts where its run of characters does, or where the match before has ended.
_LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_IP_FITS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

#: Proposals beyond the base: long runs that mix letters and digits, local telephone numbers, social
#: security numbers, spelt-out addresses, and names after a form of address.
_RUN = r"A-Za-z0-9_+/=-"
WIDE = (
    rf"(?<![{_RUN}])[{_RUN}]{{15,}}+"
    r"|(?<![0-9+])(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
    r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,64}+(?: ?[(\[.](?:dot[)\]])? ?[A-Za-z0-9-]{2,64}+){1,8}"
    r"|(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Señora?)\.? \p{Lu}\p{Ll}{1,40}(?: \p{Lu}\p{Ll}{1,40})?"
)

#: Gazetteers and context words (fixed values).
_TLD = r"(?i)\.(?:com|org|net|edu|gov|info|biz|io|co|eu|us|uk|de|fr|es|it|nl|at|ch|ca|au|jp|cn|in|br|mx|ru|pl|se)$"
_ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[4-9]|6)"
_PRIVATE = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|2[3-5][0-9])\."
_CALLING = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
_TOKEN = r"^(?:AKIA|ASIA|AIza|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|pk_live_|xox[abprs]-|eyJ|SG\.)"
_GIVEN = r"(?i)\b(?:james|john|robert|michael|william|david|mary|patricia|jennifer|linda|elizabeth|maria|anna|peter|paul|thomas|hans|klaus|jean|pierre|marie|jose|juan|carlos|carmen|ana|luis)\b"
_CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|address|addr|server|login from|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|pan)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|cell|fax|whatsapp|telefon|téléphone|teléfono)\b",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|bearer|credential)",
    "ssn": r"(?i)\b(?:ssn|social security|tax id)\b",
    "iban": r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b",
    "name": r"(?i)\b(?:name|dear|regards|signed|patient|contact)\b",
}
_AGAINST = r"(?i)\b(?:order|invoice|isbn|issn|serial|version|ref|sku|part|ticket|http|https|www|sha|commit|checksum)\W*$"
#: Characters before a span that labelers see.
_NEAR = 40

_SPAN = "array<struct<kind:string,start:int,end:int,piece:string,before:string,fits:boolean>>"


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _found(text: Column, pattern: str, kind: Column, fits) -> Column:
    """All leftmost, non-overlapping matches of ``pattern`` as spans by code point, in order.

    The gaps between the matches give their places; a text without a match is not split.
    """
    none = F.array().cast(_SPAN)
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, z: Column) -> Column:
        hit = z["hits"]
        start = acc["at"] + F.length(z["gaps"])
        end = start + F.length(hit)
        span = F.struct(
            kind(hit).alias("kind"), start.alias("start"), end.alias("end"), hit.alias("piece"),
            F.right(z["gaps"], F.lit(_NEAR)).alias("before"), fits(hit).alias("fits"),
        )
        return F.when(hit.isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    def placed(hits: Column) -> Column:
        both = F.arrays_zip(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps"))
        return F.when(F.size(hits) == 0, none).otherwise(F.aggregate(both, zero, step, lambda acc: acc["out"]))

    return _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(piece: Column) -> Column:
    return F.regexp_replace(piece, "[^0-9]", "")


def _proposals(text: Column) -> list[Column]:
    """Spans by base kind, matches that fail their check included, and the wide ones."""
    none = F.array().cast(_SPAN)
    as_is = lambda k: lambda hit: F.lit(k)
    card = lambda x: F.length(_digits(x)).between(14, 19) & F.call_function("luhn_check", _digits(x))
    phone = lambda x: F.length(_digits(x)).between(10, 15)
    wide = lambda x: F.when(x.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(x.rlike(r"[(\[]at[)\]]"), "email").when(x.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"), "phone").when(x.rlike(r" "), "name").when(x.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), "iban").otherwise("secret")
    return [
        F.when(F.contains(text, F.lit("@")), _found(text, EMAIL, as_is("email"), lambda x: F.lit(True))).otherwise(none).alias("email"),
        F.when(text.rlike(r"[0-9]\.[0-9]"), _found(text, IP, as_is("ip"), lambda x: x.rlike(_IP_FITS))).otherwise(none).alias("ip"),
        F.when(text.rlike(r"[0-9][\x20-]?[0-9]"), _found(text, CARD, as_is("card"), card)).otherwise(none).alias("card"),
        F.when(F.contains(text, F.lit("+")), _found(text, PHONE, as_is("phone"), phone)).otherwise(none).alias("phone"),
        _found(text, WIDE, wide, lambda x: F.lit(False)).alias("wide"),
    ]


def _clear_of(spans: Column, others: Column) -> Column:
    """``spans`` that overlap none of ``others``."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))


def _votes(s: Column) -> Column:
    """The labelers' votes on a span, and the classifier's other features, as one short string.

    Votes are ``+``, ``-`` or ``0`` (abstains), in the order format, gazetteer, context, shape.
    """
    p, k = s["piece"], s["kind"]
    base = k.isin(*BASE)
    mixed = p.rlike("[0-9]") & p.rlike("[A-Za-z]")
    hexed = p.rlike(r"^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})$") & mixed
    sign = lambda yes, no: F.when(yes, "+").when(no, "-").otherwise("0")
    form = (
        F.when(s["fits"], "+")
        .when(k == "secret", sign(hexed | p.rlike(_TOKEN), ~mixed | p.rlike("^[A-Za-z-]+$")))
        .when(k == "ssn", sign(~p.rlike(r"^(?:000|666|9)|-00-|-0000$"), F.lit(True)))
        .when(k == "iban", sign(F.length(p).between(15, 34), F.lit(True)))
        .when(base & p.rlike(r"[(\[]at[)\]]|^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-]"), "0")
        .when(base, "-")
        .otherwise("0")
    )
    listed = (
        F.when(k == "email", sign(F.regexp_replace(p, r" ?[(\[]dot[)\]] ?", ".").rlike(_TLD), F.lit(False)))
        .when(k == "card", sign(_digits(p).rlike(_ISSUER) & F.length(_digits(p)).between(14, 19), F.lit(True)))
        .when(k == "ip", sign(~p.rlike(_PRIVATE) & s["fits"], p.rlike(_PRIVATE)))
        .when(k == "phone", sign(p.rlike(_CALLING), F.lit(False)))
        .when(k == "secret", sign(p.rlike(_TOKEN), ~mixed))
        .when(k == "name", sign(p.rlike(_GIVEN), F.lit(False)))
        .otherwise("0")
    )
    known = F.lit(False)
    for kind, words in _CONTEXT.items():
        known = F.when(k == kind, s["before"].rlike(words)).otherwise(known)
    context = sign(known, s["before"].rlike(_AGAINST))
    share = F.length(_digits(p)) / F.greatest(F.length(p), F.lit(1))
    shape = F.when(k == "secret", sign(mixed & share.between(0.2, 0.85) & (F.length(p) >= 20), share < 0.1)).when(k == "card", sign(F.length(_digits(p)).isin(15, 16), F.lit(False))).when(k == "phone", sign(p.rlike(r"[ ().-]"), F.lit(False))).otherwise("0")
    length = F.least(F.floor(F.length(p) / 8), F.lit(7)).cast("string")
    opened = F.when(s["before"].rlike(r"[=:\"'(]\s*[\"'(]?$"), "q").otherwise("n")
    return F.concat(form, listed, context, shape, length, opened)


def proposals(docs: DataFrame, *kept: str) -> DataFrame:
    """The ``kept`` columns as the struct ``row``, the ``base`` spans, and ``more`` that the method is to decide on, each with its ``key``."""
    own = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.lit(None)
    df = docs.select(own.alias("row"), *_proposals(F.coalesce(F.col("text"), F.lit(""))))
    df = df.withColumn("base", F.concat(*(F.filter(k, lambda s: s["fits"]) for k in BASE)))
    failed = F.filter(F.concat(*BASE), lambda s: ~s["fits"])
    df = df.withColumn("more", _clear_of(F.concat(F.col("wide"), failed), F.col("base")))
    key = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.concat(s["kind"], F.lit(":"), _votes(s)).alias("key"))
    return df.select("row", F.transform("base", key).alias("base"), F.transform("more", key).alias("more"))


def estimate(counts: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Posterior of each ``kind:votes...`` key from the counts of all, by expectation-maximisation for each kind.

    Each labeler has a rate of votes for either class, with prior counts that hold it to be better than chance.
    The posteriors, as soft labels, then train a naive Bayes classifier over votes, length and opening; its
    posteriors are returned.
    """
    out: dict[str, float] = {}
    for kind in {k.split(":")[0] for k in counts}:
        own = {k.split(":", 1)[1]: n for k, n in counts.items() if k.split(":")[0] == kind}
        post = {k: 1 / (1 + math.exp(-1.5 * (k[:4].count("+") - k[:4].count("-")))) for k in own}
        prior = {(i, c, v): 6.0 if v == ("+" if c else "-") else 3.0 if v == "0" else 1.0 for i in range(4) for c in (0, 1) for v in "+-0"}

        def odds(k: str, rates: dict, share: float) -> float:
            z = math.log(share / (1 - share)) + sum(math.log(rates[i, 1, k[i]] / rates[i, 0, k[i]]) for i in range(4))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        for _ in range(rounds):
            sums = dict(prior)
            mass = [2.0, 2.0]
            for k, n in own.items():
                for c, p in ((1, post[k]), (0, 1 - post[k])):
                    mass[c] += n * p
                    for i in range(4):
                        sums[i, c, k[i]] += n * p
            rates = {(i, c, v): sums[i, c, v] / sum(sums[i, c, u] for u in "+-0") for i, c, v in prior}
            if kind in CHECKED:
                rates[0, 1, "-"] = min(rates[0, 1, "-"], MISSED)
            share = mass[1] / sum(mass)
            post = {k: odds(k, rates, share) for k in own}

        features = lambda k: [*enumerate(k[:4]), (4, k[4]), (5, k[5])]
        values = {(i, v) for k in own for i, v in features(k)}
        soft = {(i, v, c): 1.0 for i, v in values for c in (0, 1)}
        mass = [1.0, 1.0]
        for k, n in own.items():
            for c, p in ((1, post[k]), (0, 1 - post[k])):
                mass[c] += n * p
                for i, v in features(k):
                    soft[i, v, c] += n * p
        whole = {(i, c): sum(soft[j, v, c] for j, v in values if j == i) for i, c in itertools.product(range(6), (0, 1))}
        for k in own:
            z = math.log(mass[1] / mass[0])
            for i, v in features(k):
                real = soft[i, v, 1] / whole[i, 1]
                if kind in CHECKED and (i, v) == (0, "-"):
                    real = min(real, MISSED)
                z += math.log(real) - math.log(soft[i, v, 0] / whole[i, 0])
            out[f"{kind}:{k}"] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return out


def accepted(found: DataFrame) -> list[str]:
    """Keys of the proposals that the classifier accepts, learnt from all rows of ``proposals``."""
    keys = found.select(F.explode(F.concat("base", "more")).alias("s")).groupBy("s.key").count().collect()
    post = estimate({r["key"]: r["count"] for r in keys})
    return sorted(k for k, p in post.items() if p >= 0.5)


def _listed(spans: Column) -> Column:
    """Spans as sorted ``(start, place of the kind, text)``."""
    place = lambda s: F.array_position(F.array(*(F.lit(k) for k in KINDS)), s["kind"])
    word = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"), word(s).alias("word"))))


def _chosen(found: DataFrame) -> DataFrame:
    """``found`` with those of the ``more`` spans that the classifier accepts."""
    keys = accepted(found)
    return found.withColumn("more", F.filter("more", lambda s: s["key"].isin(keys) if keys else F.lit(False)))


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row of ``docs (doc_id, text, ...)``.

    Spans are by code point, end exclusive. The classifier's come beside the base ones and overlap none of them.

    Null or empty text: no spans. Null or repeated doc_id: each row is returned by itself. Of spans with one
    start, kinds go in the order of ``KINDS``. Empty table: empty result. Very long texts are read whole.
    Other columns are ignored, whatever their names.
    """
    chosen = _chosen(common.cut(proposals(docs, "doc_id"), "spans")[0])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda spans: F.array_join(F.transform(_listed(spans), lambda s: s["word"]), ",")
    digest = F.sha2(joined(F.col("base")), 256).alias("base_sha256")
    return chosen.select("row.doc_id", *(count(k) for k in BASE), digest, joined(F.concat("base", "more")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with each span replaced by its kind, as ``<EMAIL>``; columns as they are.

    ``n_chars``, where there is such a column, follows. Overlapping spans are replaced as one, under the first one's
    kind. The patterns run once: rows and proposals are written, learnt from, and redacted from that table.

    Null texts and texts without spans come back unchanged. Null or repeated doc_id: each row is returned by itself.
    Empty table: empty result. Very long texts are read whole. Other columns come back as they are, whatever their names.
    """
    names = docs.columns
    found = _chosen(common.cut(proposals(docs, *names), "spans")[0])
    text = F.col("row").getField("text")
    # Text between the spans, and each span's mark unless one before covers its start.
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    changed = F.size("spans") > 0
    out = found.select("row", _listed(F.concat("base", "more")).alias("spans"))
    out = out.withColumn("clean", F.when(changed, F.aggregate("spans", zero, step, rest)).otherwise(text))

    def value(c: str) -> Column:
        if c == "text":
            return F.col("clean")
        own = F.col("row").getField(c)
        return F.when(changed, F.length("clean").cast(docs.schema[c].dataType)).otherwise(own) if c == "n_chars" else own

    return out.select(*(value(c).alias(c) for c in names))
