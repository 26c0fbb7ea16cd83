"""Operator 9: personal data by weak supervision, in DataFrame operations only.

Base spans are found by one pattern for each kind, leftmost and without overlap, and kept if they pass the
kind's test (parts at most 255, Luhn, number of digits). Further candidates (addresses spelled out, phone
numbers without a country code, long secrets with digits in the text) are put to three labelers: the form of the span (regex), lists
of known endings, prefixes and words (gazetteer), and the words before it (context). Each votes for, against, or
abstains. Candidates of the whole table are counted by kind, features and votes; expectation-maximisation over
these counts estimates how far each labeler is to be trusted, with base spans as examples that are known to be personal data. A
naive Bayes classifier over features of the span (length, share of digits, mixed case), of its context (what stands before it) and
the votes is trained on the posteriors. Candidates it puts at 0.5 or more are added unless they overlap a base span or an
earlier candidate that was accepted. Base spans always stay.

Positions are code points, the end is exclusive. They follow from the lengths of the matches and of the
text between them, so no Python is needed. A null text is an empty one and has no spans; repeated rows are
treated alike; an empty table gives an empty result. Patterns never backtrack over a run of characters
from each of its positions, and sums and overlaps along a text are worked out in ``STRETCH`` entries at a time, so time grows
with the length of a text and a little more than in proportion to its spans. ``redact`` copies what stands between
spans from stretches of the text. Only the named columns are read. The driver gets the counts by kind, features and votes
alone: some ten thousand rows at most, whatever the input.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\((?i:at)\)|\[(?i:at)\]|(?<=\x20)(?i:at)\x20)\x20?[A-Za-z0-9-]{1,63}+\x20?(?:\((?i:dot)\)|\[(?i:dot)\]|(?<=\x20)(?i:dot)\x20)\x20?[A-Za-z]{2,24}+",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+",
}
IP_PARTS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
# fixed values: what the labelers look for
FORM = {
    "email": r"[A-Za-z0-9]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$|(?i:[(\[]at[)\]])",
    "ip": IP_PARTS,
    "card": r"^(?:[0-9]{4}[\x20-]?){3}[0-9]{1,7}$",
    "phone": r"^\+?1?\x20?\([0-9]{3}\)|^[0-9]{3}-[0-9]{3}-[0-9]{4}$|^\+[0-9]{1,3}\x20",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])(?!.*[A-Za-z]{12})",
}
# fixed values: lists that the gazetteer knows
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "eu", "ch", "at", "it", "nl", "ca", "au", "us", "biz", "me", "co")
NOT_PERSONAL_HOSTS = ("example", "test", "invalid", "localhost", "noreply", "no-reply", "donotreply")
PRIVATE_NETS = ("10", "127", "172", "192", "169")
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "36", "30")
DIAL_CODES = ("1", "33", "34", "44", "49", "39", "31", "41", "43", "32", "351", "353")
FICTION_NUMBERS = ("55501", "5550100", "0000000", "1234567", "1111111")
TOKEN_HEADS = ("ghp_", "gho_", "sk-", "pk-", "AKIA", "xoxb-", "xoxp-", "xoxa-", "glpat-", "AIza", "ya29", "eyJ")
PLAIN_HEADS = ("http", "www", "data", "image", "lorem", "aaaa", "0000", "xxxx", "----", "====", "____")
WORDS_FOR = {
    "email": ("mail", "e-mail", "email", "contact", "write", "address", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "from", "client"),
    "card": ("card", "visa", "mastercard", "payment", "credit", "account", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telefon", "call", "mobile", "fax", "téléphone", "teléfono", "cell"),
    "secret": ("token", "secret", "key", "apikey", "password", "passwd", "auth", "credential", "bearer"),
}
WORDS_AGAINST = {
    "email": ("sample", "placeholder"), "ip": ("version", "release", "section"), "card": ("isbn", "order", "invoice", "number of"),
    "phone": ("isbn", "order", "invoice", "page", "pages", "lines"), "secret": ("sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "hash", "revision", "id"),
}


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(map(re.escape, words)) + ")"


GAZETTEER = {
    "email": rf"(?i)(?:\.|dot[)\]]?\x20?){_any(ENDINGS)}$",
    "ip": rf"^{_any(PRIVATE_NETS)}\.",
    "card": rf"^{_any(ISSUERS)}",
    "phone": rf"^\+?{_any(DIAL_CODES)}?[\x20.-]?\(?[2-9][0-9]{{2}}",
    "secret": rf"^(?:{_any(TOKEN_HEADS)}|(?:[0-9a-f]{{8}})+$|(?:[0-9A-F]{{8}})+$)",
}
GAZETTEER_AGAINST = {
    "email": rf"(?i){_any(NOT_PERSONAL_HOSTS)}", "ip": r"^(?:0|255)\.", "card": r"^(?:0|1|9)",
    "phone": rf"^[^0-9]*(?:[0-9][^0-9]*){{0,5}}{'|'.join('[^0-9]*'.join(n) for n in FICTION_NUMBERS)}", "secret": rf"(?i)^{_any(PLAIN_HEADS)}",
}
_SINCE = {"secret": r"[\x20\"':=]{1,6}$"}
CONTEXT = {k: rf"(?i)\b{_any(w)}{_SINCE.get(k, r'[^\n]{0,12}$')}" for k, w in WORDS_FOR.items()}
CONTEXT_AGAINST = {k: rf"(?i)\b{_any(w)}[\x20\"':=#]{{0,6}}$" for k, w in WORDS_AGAINST.items()}
AGAINST = {
    "email": r"^[.%+_-]|\.\.",
    "ip": r"^0|\.0[0-9]",
    "card": r"^0|([0-9])\1{7}",
    "phone": r"^\+0|^\(?[01]",
    "secret": r"^[A-Za-z_+/=-]*$|^[0-9_+/=-]*$",
}
LABELERS = 3
STRETCH = 128


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return F.when(F.length(_digits(value)).between(13, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _cell(kind: str, base: bool, value: Column, before: Column) -> Column:
    """Kind, features and votes as one short string; that of a base span has ``base`` before its features."""
    n, digits = F.length(value), F.length(_digits(value))
    near = F.right(before, F.lit(40))
    mark = F.regexp_extract(near, r"([^\x20])\x20*$", 1)
    features = F.concat_ws(
        ".", F.when(n < 24, "short").when(n < 36, "middle").otherwise("long"), F.when(digits * 4 < n, "few").when(digits * 2 < n, "some").otherwise("most"), F.when(value.rlike("[a-z]") & value.rlike("[A-Z]"), "mixed").otherwise("even"),
        F.when(mark == "", "start").when(mark.isin("=", ":"), "given").when(mark.isin('"', "'", "`"), "quoted").when(mark.rlike("[0-9A-Za-z]"), "word").otherwise("other"),
    )
    vote = lambda told, yes, no: F.when(told.rlike(yes), "+").when(told.rlike(no), "-").otherwise("0")
    votes = (vote(value, FORM[kind], AGAINST[kind]), vote(value, GAZETTEER[kind], GAZETTEER_AGAINST[kind]), vote(near, CONTEXT[kind], CONTEXT_AGAINST[kind]))
    return F.concat(F.lit(f"{kind} "), *([F.lit("base.")] if base else []), features, F.lit(" "), *votes)


SPAN = "array<struct<kind:int,start:int,end:int,base:boolean,cell:string>>"


def _running(df: DataFrame, columns: dict[str, Column], zero: int, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """Columns of what an associative function makes of all entries of an array up to each, the entry included.

    Entries are taken ``STRETCH`` at a time: arrays that grow entry by entry are copied each time, so none grows long. Each step is
    a column of its own, which keeps functions within functions few.
    """
    first, grown = F.lit(zero), lambda told, v: F.concat(told, F.array(combine(F.element_at(told, -1), v)))
    none = F.array().cast("array<int>")

    def pieces(name: str) -> Column:
        last = F.floor((F.size(name) - 1) / STRETCH).cast("int")
        return F.when(F.size(name) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(name, i * STRETCH + 1, STRETCH))).otherwise(F.array().cast("array<array<int>>"))

    steps = df.withColumns({f"{n}_v": v for n, v in columns.items()})
    steps = steps.withColumns({f"{n}_p": pieces(f"{n}_v") for n in columns})
    steps = steps.withColumns({f"{n}_w": F.transform(f"{n}_p", lambda piece: F.aggregate(piece, first, combine)) for n in columns})
    steps = steps.withColumns({f"{n}_b": F.aggregate(f"{n}_w", F.array(first), grown) for n in columns})
    steps = steps.withColumns({n: F.coalesce(F.flatten(F.zip_with(f"{n}_p", F.slice(f"{n}_b", F.lit(1), F.size(f"{n}_p")), lambda piece, b: F.slice(F.aggregate(piece, F.array(b), grown), 2, STRETCH))), none) for n in columns})
    return steps.drop(*[f"{n}_{t}" for n in columns for t in "vpwb"])


PATTERNS = [(kind, pattern, True) for kind, pattern in BASE.items()] + [(kind, pattern, False) for kind, pattern in LOOSE.items()]


def _with_spans(df: DataFrame, body: str) -> DataFrame:
    """``base_spans`` and ``more_spans`` of a text without nulls. Gaps and matches alternate, so running sums of their lengths are
    the positions."""
    text = F.col(body)
    digit = text.rlike("[0-9]")
    # what a text must hold for a pattern to match at all; cheaper than the pattern
    needs = [F.contains(text, F.lit("@")), digit, digit, digit & F.contains(text, F.lit("+")), F.contains(F.lower(text), F.lit("dot")), digit, digit]
    none, at = F.array().cast("array<string>"), range(len(PATTERNS))
    steps = df.withColumns({f"f{i}": F.when(needs[i], F.regexp_extract_all(text, F.lit(PATTERNS[i][1]), F.lit(0))).otherwise(none) for i in at})
    steps = steps.withColumns({f"g{i}": F.when(F.size(f"f{i}") > 0, F.slice(F.split(text, PATTERNS[i][1], -1), F.lit(1), F.size(f"f{i}"))).otherwise(none) for i in at})
    steps = _running(steps, {f"e{i}": F.zip_with(f"g{i}", f"f{i}", lambda g, v: F.length(g) + F.length(v)) for i in at}, 0, lambda a, b: a + b)

    def spans(i: int) -> Column:
        kind, _, base = PATTERNS[i]

        def span(z: Column, end: Column) -> Column:
            value = z["value"]
            shown = F.struct(F.lit(KINDS.index(kind)).alias("kind"), (end - F.length(value)).alias("start"), end.alias("end"), F.lit(base).alias("base"), _cell(kind, base, value, z["gap"]).alias("cell"))
            return F.when(_valid(kind, value), shown) if base else shown

        return F.zip_with(f"z{i}", f"e{i}", span).cast(SPAN)

    steps = steps.withColumns({f"z{i}": F.zip_with(f"g{i}", f"f{i}", lambda g, v: F.struct(g.alias("gap"), v.alias("value"))) for i in at})
    steps = steps.withColumns({f"s{i}": spans(i) for i in at})
    steps = steps.withColumn("base_spans", F.filter(F.concat(*[f"s{i}" for i in at if PATTERNS[i][2]]), lambda x: x.isNotNull()))
    steps = steps.withColumn("more_spans", F.concat(*[f"s{i}" for i in at if not PATTERNS[i][2]]))
    return _apart(steps.drop(*[f"{c}{i}" for i in at for c in "fgezs"]))


def _ordered(spans: Column) -> Column:
    """Spans in order of start, the longer first, base spans before others."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("till"), (~s["base"]).alias("more"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda k: k["span"])


def _apart(df: DataFrame) -> DataFrame:
    """``more_spans`` without those that overlap a base span."""
    both = F.when((F.size("base_spans") > 0) & (F.size("more_spans") > 0), F.concat("base_spans", "more_spans")).otherwise(F.array().cast(SPAN))
    steps = df.withColumn("both", both).withColumn("both", _ordered(F.col("both"))).withColumn("back", F.reverse("both"))
    steps = _running(steps, {"ends": F.transform("both", lambda s: F.when(s["base"], s["end"]).otherwise(0))}, 0, lambda a, b: F.greatest(a, b))
    steps = _running(steps, {"starts": F.transform("back", lambda s: F.when(s["base"], s["start"]).otherwise(2**31 - 1))}, 2**31 - 1, lambda a, b: F.least(a, b))
    steps = steps.withColumn("free", F.zip_with("ends", F.reverse("starts"), lambda e, n: F.struct(e.alias("e"), n.alias("n"))))
    steps = steps.withColumn("free", F.zip_with("both", "free", lambda s, z: F.when(~s["base"] & (z["e"] <= s["start"]) & (z["n"] >= s["end"]), s)))
    alone = F.filter("free", lambda s: s.isNotNull())
    return steps.withColumn("more_spans", F.when(F.size("both") > 0, alone).otherwise(F.col("more_spans"))).drop("both", "back", "ends", "starts", "free")


def _scanned(df: DataFrame, text_col: str) -> DataFrame:
    return _with_spans(df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(""))), text_col)


def cell_counts(df: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Number of candidates of the whole table by kind, features and votes."""
    cells = _scanned(df.select(F.col(text_col).alias("text")), "text").select(F.explode(F.concat("base_spans", "more_spans")["cell"]).alias("cell"))
    return {r.cell: r.n for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}


def estimate(counts: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], list[dict[str, dict[str, float]]]]:
    """EM with labelers independent given the truth: posterior of each cell, and each labeler's votes by truth."""
    cells = sorted(counts)
    parts = {c: c.split(" ") for c in cells}
    votes = [{"yes": {"+": 0.7, "0": 0.25, "-": 0.05}, "no": {"+": 0.1, "0": 0.5, "-": 0.4}} for _ in range(LABELERS)]
    prior = {kind: 0.5 for kind in KINDS}
    posterior: dict[str, float] = {}
    for _ in range(rounds):
        for c in cells:
            kind, shape, vote = parts[c]
            yes, no = prior[kind], 1 - prior[kind]
            if shape.startswith("base"):  # an example that is known
                posterior[c] = 1.0
                continue
            for labeler, v in zip(votes, vote):
                yes, no = yes * labeler["yes"][v], no * labeler["no"][v]
            posterior[c] = yes / (yes + no)
        for kind in KINDS:
            own = [c for c in cells if parts[c][0] == kind and not parts[c][1].startswith("base")]
            total = sum(counts[c] for c in own)
            prior[kind] = (1 + sum(counts[c] * posterior[c] for c in own)) / (2 + total)
        for i, labeler in enumerate(votes):
            for truth in ("yes", "no"):
                weight = {c: counts[c] * (posterior[c] if truth == "yes" else 1 - posterior[c]) for c in cells}
                # pseudo-counts keep a labeler's votes better than chance where there are few candidates
                start = {"+": 7, "0": 2.5, "-": 0.5} if truth == "yes" else {"+": 1, "0": 5, "-": 4}
                total = sum(weight.values()) + 10
                labeler[truth] = {v: (start[v] + sum(w for c, w in weight.items() if parts[c][2][i] == v)) / total for v in "+0-"}
    return posterior, votes


def classifier(counts: dict[str, int]) -> dict[str, float]:
    """Naive Bayes over kind, features and votes, trained on the posteriors; the probability of each cell."""
    posterior, _ = estimate(counts)
    features = {c: (kind, *(f"{kind} {i}{f}" for i, f in enumerate(t for t in shown.split(".") if t != "base")), *(f"{kind} v{i}{v}" for i, v in enumerate(vote))) for c in counts for kind, shown, vote in [c.split(" ")]}
    mass = {truth: {} for truth in (0, 1)}
    for c in sorted(counts):
        for truth, p in ((1, posterior[c]), (0, 1 - posterior[c])):
            for f in features[c]:
                mass[truth][f] = mass[truth].get(f, 0.0) + counts[c] * p
    found = {}
    for c in sorted(counts):
        odds = []
        for truth in (0, 1):
            kind = mass[truth].get(features[c][0], 0.0)
            odds.append(reduce(lambda p, f: p * (mass[truth].get(f, 0.0) + 0.5) / (kind + 1.5), features[c][1:], kind + 0.5))
        found[c] = odds[1] / (odds[0] + odds[1])
    return found


def _with_added(df: DataFrame, accepted: list[str]) -> DataFrame:
    """``added``: accepted candidates in order of start, without those that begin before an earlier accepted one ends."""
    steps = df.withColumn("chosen", F.filter("more_spans", lambda m: m["cell"].isin(accepted) if accepted else F.lit(False))).withColumn("chosen", _ordered(F.col("chosen")))
    steps = _running(steps, {"till": F.transform("chosen", lambda s: s["end"])}, 0, lambda a, b: F.greatest(a, b))
    before = F.slice(F.concat(F.array(F.lit(0)), "till"), F.lit(1), F.size("chosen"))
    steps = steps.withColumn("added", F.zip_with("chosen", before, lambda s, e: F.when(e <= s["start"], s)))
    return steps.withColumn("added", F.filter("added", lambda s: s.isNotNull())).drop("chosen", "till")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def accepted_cells(df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> list[str]:
    return sorted(c for c, p in classifier(cell_counts(df, text_col)).items() if p >= threshold and " base" not in c)


def find_spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base spans by kind, digest of base spans, and all spans as text, for each row."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    accepted = accepted_cells(rows)
    found = _with_added(_scanned(rows, "text"), accepted)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        F.col("id").alias(id_col),
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base_spans", "added")).alias("spans"),
    )


PIECE = 4096  # code points of a stretch of text that redact copies from


def redact(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``df`` with each span of ``text_col`` replaced by its kind in angle brackets; null stays null. A span that begins inside
    another goes with it."""
    accepted = accepted_cells(df, text_col)
    rows = _scanned(df.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("body")), "body")
    rows = _with_added(rows, accepted).withColumn("spans", F.concat("base_spans", "added")).withColumn("spans", _ordered(F.col("spans")))
    rows = _running(rows, {"reach": F.transform("spans", lambda s: s["end"])}, 0, lambda a, b: F.greatest(a, b))
    rows = rows.withColumn("reach", F.concat(F.array(F.lit(0)), "reach"))
    rows = rows.withColumn("pieces", F.transform(F.sequence(F.lit(0), F.floor(F.length("body") / PIECE).cast("int")), lambda n: F.substr(F.col("body"), n * PIECE + 1, F.lit(PIECE))))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def text(a: Column, b: Column) -> Column:
        """Code points from a to b."""
        i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        piece = lambda n: F.element_at("pieces", n + 1)
        across = F.concat(F.substr(piece(i), a - i * PIECE + 1, F.lit(PIECE)), F.array_join(F.slice("pieces", i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substr(piece(j), F.lit(1), b - j * PIECE))
        return F.when(i == j, F.substr(piece(i), a - i * PIECE + 1, F.greatest(b - a, F.lit(0)))).otherwise(across)

    outer = F.zip_with("spans", F.slice("reach", F.lit(1), F.size("spans")), lambda s, e: F.when(s["start"] >= e, F.struct(s["kind"].alias("kind"), s["start"].alias("start"), e.alias("before"))))
    rows = rows.withColumn("outer", outer).withColumn("outer", F.filter("outer", lambda z: z.isNotNull()))
    parts = F.transform("outer", lambda z: F.concat(text(z["before"], z["start"]), F.element_at(names, z["kind"] + 1)))
    redacted = F.when(F.size("spans") == 0, F.col("body")).otherwise(F.concat(F.array_join(parts, ""), text(F.element_at("reach", -1), F.length("body"))))
    kept = [F.when(F.col("row")[c].isNull(), F.lit(None)).otherwise(redacted).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns]
    return rows.select(*kept)
