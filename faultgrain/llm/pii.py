"""Operator 1: personal data by weak supervision, on DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultgrain.llm.spark_tools import Scratch, own_id, row_id

# Equal to the plain patterns, but written so that no run of characters is tried from each of its positions and
# no repetition nests on the stack: a match may begin where a run begins or the last match ended (\G).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?=[0-9\x20-]{11})(?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{8,}+"

ACCOUNT = r"(?<![0-9+.,-])[0-9](?:[\x20-]?+[0-9]){8,18}(?![0-9]|[.,-][0-9])"

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "account")
KINDS = BASE + ADDED
NEAR = 24  # characters of context

# fixed values: names that stand before secrets, and before harmless codes
SECRET_NAMES = "token secret password passwd pwd key apikey api_key auth bearer credential access_key".split()
CODE_NAMES = "version page chapter section isbn rfc model figure release article".split()
ACCOUNT_NAMES = "account acct iban card ssn passport customer tax konto karte kontonummer cuenta tarjeta compte carte".split()
NUMBER_NAMES = "isbn issn page order invoice ticket version id timestamp population total".split()

LABELERS = 6
FEATURES = 8
#: A labeler that votes is right with a probability in these bounds: better than chance, and never certain.
RIGHT = (0.65, 0.98)


def _block(spans: str) -> Column:
    """Elements in a block of an array: the root of their number, so that work in all blocks stays near the number."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(spans)))).cast("int")


def _numbers(spans: str) -> Column:
    """The numbers of an array's blocks, from 0."""
    n = F.size(spans)
    return F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / _block(spans)).cast("int"))).otherwise(F.expr("CAST(array() AS array<int>)"))


def _spans(found: str, between: str) -> Column:
    """(start, match, before, after) of matches, from the columns of matches and of the pieces between them; starts count code points.

    before: the NEAR characters that stand before a match; after: the two behind it. Lengths are summed by block first, and each block's spans are
    then placed from its own offset: no growing array is copied for every match, and no place is looked up in the whole text.
    """
    empty = lambda kind: F.expr(f"CAST(array() AS array<{kind}>)")

    def pairs(start: Column, n: Column) -> Column:
        """(piece, match, next piece, next match) of n matches; there is one piece more than matches."""
        cut = lambda c, skip: F.slice(c, start + 1 + skip, n)
        some = F.arrays_zip(cut(between, 0).alias("piece"), cut(found, 0).alias("match"), cut(between, 1).alias("then"), cut(found, 1).alias("next"))
        return F.transform(some, lambda x: F.struct(x["piece"].alias("piece"), x["match"].alias("match"), F.left(F.concat(F.left(x["then"], F.lit(2)), F.coalesce(F.left(x["next"], F.lit(2)), F.lit(""))), F.lit(2)).alias("after")))

    def part(b: Column) -> Column:
        return pairs(b * _block(found), F.least(_block(found), F.size(found) - b * _block(found)))

    def tail(b: Column) -> Column:
        """What stands before a block: as much of the matches before it as NEAR characters can reach."""
        first = F.greatest(F.lit(0), b * _block(found) - (NEAR + 1))
        near = F.transform(pairs(first, b * _block(found) - first), lambda x: F.concat(F.right(x["piece"], F.lit(NEAR)), x["match"]))
        return F.right(F.array_join(near, ""), F.lit(NEAR))

    length = lambda x: F.length(x["piece"]) + F.length(x["match"])
    sums = F.transform(_numbers(found), lambda b: F.aggregate(part(b), F.lit(0), lambda at, x: at + length(x)))
    zero = F.struct(F.lit(0).alias("at"), empty("int").alias("out"))
    offsets = F.aggregate(sums, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def placed(offset: Column, b: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            before = F.right(F.concat(a["tail"], F.right(x["piece"], F.lit(NEAR))), F.lit(NEAR))
            span = F.struct((a["at"] + F.length(x["piece"])).alias("start"), x["match"].alias("match"), before.alias("before"), x["after"].alias("after"))
            return F.struct((a["at"] + length(x)).alias("at"), F.right(F.concat(before, x["match"]), F.lit(NEAR)).alias("tail"), F.concat(a["out"], F.array(span)).alias("out"))

        start = F.struct(offset.alias("at"), tail(b).alias("tail"), empty("struct<start: int, match: string, before: string, after: string>").alias("out"))
        return F.aggregate(part(b), start, step, lambda a: a["out"])

    return F.flatten(F.transform(offsets, placed))


def _blocks(spans: str) -> Column:
    """Spans in the order of their starts, in blocks with the least start and the greatest end."""
    cut = lambda b: F.slice(spans, b * _block(spans) + 1, _block(spans))
    ends = lambda b: F.array_max(F.transform(cut(b), lambda s: s["end"]))
    return F.transform(_numbers(spans), lambda b: F.struct(F.get(F.col(spans), b * _block(spans))["start"].alias("low"), ends(b).alias("high"), cut(b).alias("spans")))


def _apart(blocks: str, x: Column) -> Column:
    """Whether a span overlaps none of those in ``blocks``."""
    over = lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])
    return ~F.exists(blocks, lambda b: (b["low"] < x["end"]) & (x["start"] < b["high"]) & F.exists(b["spans"], over))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, d).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, "\\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(12, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _word(before: Column) -> Column:
    return F.lower(F.regexp_extract(before, r"([A-Za-z_]+)[^A-Za-z_]{0,4}$", 1))


def _votes(kind: str, m: Column, before: Column, after: Column) -> list[Column]:
    """Of each labeler 1 (personal or secret), -1 (neither) or 0 (abstains)."""
    word, digits = _word(before), _digits(m)
    share = F.length(digits) / F.length(m)
    if kind == "secret":
        return [
            F.when(m.rlike("^[0-9a-f]{16,}$"), 1).when(m.rlike("^[A-Za-z]+[0-9]{1,2}$|^[0-9]{1,4}[a-z]+$"), -1).otherwise(0),
            F.when(m.rlike("^(?:AKIA|ASIA|ghp_|gho_|sk-|xox[abp]-)[A-Za-z0-9_-]{8,}$"), 1).otherwise(0),
            F.when(word.isin(SECRET_NAMES), 1).when(word.isin(CODE_NAMES), -1).otherwise(0),
            F.when(before.rlike("[=:]\\s?[\"']?$"), 1).when(before.rlike("[A-Za-z,.]\\s$"), -1).otherwise(0),
            F.when(share >= 0.25, 1).when(share < 0.1, -1).otherwise(0),
            F.when(before.rlike("[\"'`]$") & after.rlike("^[\"'`]"), 1).when(m.rlike("^[a-z]+(?:[/_-][a-z0-9]+)+$"), -1).otherwise(0),
        ]
    return [
        F.when(F.length(digits) >= 15, 1).when(F.length(digits) <= 10, -1).otherwise(0),
        F.when(digits.rlike("^(?:4|5[1-5]|3[47]|6(?:011|5))"), 1).otherwise(0),
        F.when(word.isin(ACCOUNT_NAMES), 1).when(word.isin(NUMBER_NAMES), -1).otherwise(0),
        F.when(before.rlike("[=:#]\\s?$"), 1).when(before.rlike("[.,(]$") | after.rlike("^[A-Za-z%]"), -1).otherwise(0),
        F.when(m.rlike("^[0-9]{4}(?:[ -][0-9]{4}){2,3}$"), 1).when(m.rlike("^(?:[0-9]{1,3} )+[0-9]{1,3}$"), -1).otherwise(0),
        F.when(digits.rlike("^([0-9])\\1+$|^0?12345678|000000"), -1).when(m.rlike("^[0-9]{16}$"), 1).otherwise(0),
    ]


def _features(kind: str, m: Column, before: Column) -> list[Column]:
    digits = _digits(m)
    if kind == "secret":
        return [
            m.rlike("^[0-9a-f]+$"),
            F.length(m) >= 16,
            F.length(m) >= 32,
            F.length(digits) * 4 >= F.length(m),
            m.rlike("^[A-Z0-9]+$"),
            F.lower(before).rlike("|".join(SECRET_NAMES)),
            before.rlike("[=:\"']\\s?[\"']?$"),
            m.rlike("[/_-].*[/_-]"),
        ]
    return [
        F.length(digits) >= 12,
        F.length(digits) >= 15,
        F.length(digits) == 16,
        m.rlike("[ -]"),
        m.rlike("^[0-9]{4}[ -]"),
        F.lower(before).rlike("|".join(ACCOUNT_NAMES)),
        before.rlike("[=:#]\\s?$"),
        digits.rlike("([0-9])\\1{4}"),
    ]


def _packed(values: list[Column], base: int, least: int) -> Column:
    out = F.lit(0)
    for i, v in enumerate(values):
        out = out + (v.cast("int") - least) * base**i
    return out


def scanned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k_id, base, likely): base spans (start, kind, end), and likely added ones (start, kind, end, votes, features)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(row_id(id_col).alias("k_id"), text.alias("text"))
    has = {
        "email": F.contains("text", F.lit("@")),
        "ip": F.col("text").rlike("[0-9]\\.[0-9]"),
        "card": F.col("text").rlike("[0-9](?:[\\x20-]?[0-9]){11}"),  # the fewest digits of a card
        "phone": F.contains("text", F.lit("+")),
        "secret": F.col("text").rlike("[0-9]"),
        "account": F.col("text").rlike("[0-9](?:[\\x20-]?[0-9]){8}"),
    }
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, SECRET, ACCOUNT), strict=True))
    none = F.expr("CAST(array() AS array<string>)")
    rows = rows.withColumns({f"m_{k}": F.when(has[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    rows = rows.withColumns({f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).otherwise(none) for k, p in patterns.items()})
    rows = rows.withColumns({f"s_{k}": _spans(f"m_{k}", f"p_{k}") for k in KINDS})

    def good(i: int, kind: str) -> Column:
        passed = F.filter(f"s_{kind}", lambda x: _valid(kind, x["match"]))
        return F.transform(passed, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), (x["start"] + F.length(x["match"])).alias("end")))

    rows = rows.withColumn("base", F.array_sort(F.concat(*(good(i, k) for i, k in enumerate(BASE)))))

    def likely(i: int, kind: str) -> Column:
        def one(x: Column) -> Column:
            end = x["start"] + F.length(x["match"])
            votes = _packed(_votes(kind, x["match"], x["before"], x["after"]), 3, -1)
            features = _packed(_features(kind, x["match"], x["before"]), 2, 0)
            return F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), end.alias("end"), votes.alias("votes"), features.alias("features"))

        return F.transform(f"s_{kind}", one)

    rows = rows.withColumns({"base_blocks": _blocks("base"), "secrets": likely(len(BASE), "secret"), "accounts": likely(len(BASE) + 1, "account")})
    rows = rows.withColumn("secrets", F.filter("secrets", lambda x: _apart("base_blocks", x)))
    rows = rows.withColumn("secret_blocks", _blocks("secrets"))
    numbers = F.filter("accounts", lambda x: _apart("base_blocks", x) & _apart("secret_blocks", x))
    return rows.select("k_id", "base", F.array_sort(F.concat("secrets", numbers)).alias("likely"))


def reliabilities(counts: dict[int, int], rounds: int = 100) -> tuple[list[float], dict[int, float]]:
    """Expectation-maximisation over vote patterns: (how often each labeler is right when it votes, P(yes | pattern)).

    ``counts`` has at most 3**LABELERS patterns, whatever the corpus. The two classes are alike but for the bounds of
    RIGHT, which keep every labeler on its own side; both classes start from even odds, and abstaining says nothing.
    So rows of other texts can't turn a labeler round, and a pattern whose votes all say yes stays one.
    """
    votes = {p: [p // 3**j % 3 - 1 for j in range(LABELERS)] for p in counts}
    right = [0.8] * LABELERS
    belief: dict[int, float] = {}
    for _ in range(rounds):
        new = {}
        for p, v in votes.items():
            odds = sum(x * math.log(r / (1 - r)) for x, r in zip(v, right, strict=True))
            new[p] = 1 / (1 + math.exp(-odds))
        moved = max((abs(new[p] - belief.get(p, 0.5)) for p in new), default=0)
        belief = new
        for j in range(LABELERS):
            cast = [(n, belief[p] if votes[p][j] > 0 else 1 - belief[p]) for p, n in counts.items() if votes[p][j]]
            # 8 right and 2 wrong votes are taken for granted
            share = (8 + sum(n * b for n, b in cast)) / (10 + sum(n for n, _ in cast))
            right[j] = min(max(share, RIGHT[0]), RIGHT[1])
        if moved < 1e-9:
            break
    return right, belief


def span_classifier(rows: list[tuple[int, int, int]], belief: dict[int, float], rounds: int = 600, rate: float = 2.0, reg: float = 1e-3) -> list[float]:
    """Logistic regression on features, the beliefs as labels: FEATURES weights and the bias.

    ``rows``: (votes, features, count), at most 3**LABELERS * 2**FEATURES of them. Each feature pattern counts once, with
    the mean belief of its spans: how often others occur in the corpus doesn't move the boundary.
    """
    mass: dict[int, list[float]] = {}
    for votes, features, n in rows:
        m = mass.setdefault(features, [0.0, 0.0])
        m[0] += n
        m[1] += n * belief[votes]
    target = [([f >> k & 1 for k in range(FEATURES)] + [1], yes / n) for f, (n, yes) in sorted(mass.items())]
    w = [0.0] * (FEATURES + 1)
    for _ in range(rounds):
        step = [reg * x for x in w]
        for bits, yes in target:
            miss = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, bits, strict=True)))) - yes
            for k, b in enumerate(bits):
                if b:
                    step[k] += miss / len(target)
        w = [a - rate * s for a, s in zip(w, step, strict=True)]
    return w


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_account, flagged.

    Base spans are the leftmost non-overlapping matches of each kind's pattern that pass its test; base_sha256 is
    over their kind:start:end, by start and then kind, in code points. ``spans`` lists them with what the method
    adds: secrets (keys, tokens, passwords) and accounts (numbers of 9 to 19 digits that are no base span). Added
    spans never overlap base ones or each other. flagged: there is any span.

    Six labelers vote on each likely span: by shape, by known prefixes, by a gazetteer of the word before it, by
    context, by its make-up and by what encloses it. Their votes are counted over the whole corpus for each added kind;
    expectation-maximisation estimates each one's reliability from the counts, and its beliefs train the classifier of
    spans that decides. Only counts of vote and feature patterns (at most 3**6 * 2**8 a kind) reach the driver.

    A null or empty text has no spans. Rows that repeat get rows of their own; an id may be null. An empty table
    gives no rows. Other columns are ignored.
    """
    seen = Scratch(docs.sparkSession).written(scanned(docs, id_col=id_col, text_col=text_col), "pii-spans", keep=True)
    each = seen.select(F.explode("likely").alias("x")).groupBy("x.kind", "x.votes", "x.features").agg(F.count(F.lit(1)).alias("n"))
    found = sorted((r.kind, r.votes, r.features, r.n) for r in each.collect())
    weights = {}
    for kind in range(len(BASE), len(KINDS)):
        rows = [r[1:] for r in found if r[0] == kind]
        by_votes: dict[int, int] = {}
        for votes, _, n in rows:
            by_votes[votes] = by_votes.get(votes, 0) + n
        weights[kind] = span_classifier(rows, reliabilities(by_votes)[1]) if rows else [0.0] * (FEATURES + 1)

    def sure(x: Column) -> Column:
        out = F.lit(False)
        for kind, w in weights.items():
            total = F.lit(w[-1])
            for k in range(FEATURES):
                total = total + F.lit(w[k]) * F.shiftright(x["features"], k).bitwiseAND(F.lit(1))
            out = out | ((x["kind"] == kind) & (total > 0))
        return out

    added = F.transform(F.filter("likely", sure), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    seen = seen.withColumn("all", F.array_sort(F.concat("base", added)))
    names = F.array(*map(F.lit, KINDS))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda i: F.size(F.filter("all", lambda s: s["kind"] == i)).cast("long")
    return seen.select(
        own_id().alias("doc_id"),
        *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2(shown("base"), 256).alias("base_sha256"),
        shown("all").alias("spans"),
        *(count(len(BASE) + i).alias(f"n_{k}") for i, k in enumerate(ADDED)),
        (F.size("all") > 0).alias("flagged"),
    )
