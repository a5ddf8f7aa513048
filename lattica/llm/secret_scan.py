"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans are found by fixed patterns.  Weak candidates (short access identifiers, login names, short secrets,
endpoints) are reported only when a complementary part stands in the same scope: an interval join within a
document, on blocks of positions, of weak spans with the spans of the other parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import kept, prepare, small

# The base patterns and the least lengths of their matches.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

# The weak candidates of the linking stage.
WEAK_SECRET_LEAST = 6
WEAK_ACCESS_LEAST = 12
LOGIN = r"""(?i)(?:username|user_?id|user|login|client_?id|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""
ENDPOINT = r"""(?:https?|ftp|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"""
#: Code points between two parts of one credential, at most.
SCOPE = 200

# What stands, in lower case, in every match of the longer patterns: plain searches that keep most texts from them.
ASSIGN_SIGNS = ("passw", "secret", "token", "apikey", "api_key")
LOGIN_SIGNS = ("user", "login", "client", "account")
ENDPOINT_SIGN, ACCESS_SIGN = "://", "AKIA"

#: Kinds in the order that ties at one start are listed in.
KINDS = ["assign", "access", "hex", "weak_secret", "weak_access", "login", "endpoint"]
#: Matches of a text whose positions are added up in one go.
BLOCK = 64
_SPAN = "struct<start:int,rank:int,end:int>"


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _any_of(text: Column, signs: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(x)) for x in signs))


def _spans(text: Column, pattern: str, rank: Column | int, least: int = 0) -> Column:
    """Matches of ``pattern`` as structs (start, rank, end) in code points, from the text's matches and gaps.

    ``pattern`` must not match the empty string.  Positions are running sums of the lengths, first within blocks of
    matches, so that a text with very many of them costs about as much a match as one with a few.
    """
    steps = _with(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m)), lambda lengths: F.zip_with(
        F.slice(F.transform(F.split(text, pattern, -1), lambda g: F.length(g)), 1, F.size(lengths)), lengths, lambda g, m: F.struct(g.alias("g"), m.alias("m"))))
    blocks = _with(steps, lambda x: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / BLOCK).cast("int") - 1, F.lit(0))), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK))))
    none = F.array().cast(f"array<{_SPAN}>")

    def within(at: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), lambda acc, x: F.struct(
            (acc["at"] + x["g"] + x["m"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + x["g"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + x["g"] + x["m"]).alias("end")))).alias("out")))

    walked = F.flatten(F.aggregate(
        blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out")),
        lambda acc, block: _with(within(acc["at"], block), lambda one: F.struct(one["at"].alias("at"), F.concat(acc["out"], F.array(one["out"])).alias("out"))),
        lambda acc: acc["out"]))
    return F.filter(walked, lambda s: s["end"] - s["start"] >= least) if least else walked


def _where(test: Column, spans: Column) -> Column:
    """``spans`` of a text that passes ``test``, none of others."""
    return F.when(test, spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _assigned(text: Column) -> Column:
    """Assignments: base spans where the value has 12 or more characters, weak ones from 6 on."""
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    ranked = F.zip_with(_spans(text, ASSIGN, 0), value, lambda s, v: F.struct(
        s["start"].alias("start"), F.when(F.length(v) >= ASSIGN_LEAST, 0).otherwise(3).alias("rank"), s["end"].alias("end"), F.length(v).alias("n")))
    enough = F.filter(ranked, lambda s: s["n"] >= WEAK_SECRET_LEAST)
    return F.transform(enough, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))


def _access(text: Column) -> Column:
    long = _spans(text, ACCESS, 1, WEAK_ACCESS_LEAST)
    return F.transform(long, lambda s: F.struct(
        s["start"].alias("start"), F.when(s["end"] - s["start"] >= ACCESS_LEAST, 1).otherwise(4).alias("rank"), s["end"].alias("end")))


def found_in(text: Column) -> Column:
    """All base spans and weak candidates of a text, sorted: array<struct<start, rank, end>>.

    A pattern is tried on texts that hold what all its matches hold, and its matches are taken where it is found.
    """
    t = F.coalesce(text, F.lit(""))
    # a maximal run of hex digits that is long enough is what filtering all runs by length would leave
    long_hex = HEX[:-1] + "{%d,}" % HEX_LEAST
    # letters beyond ASCII may become ASCII ones here: then a pattern is tried in vain
    named = _with(F.lower(t), lambda low: F.struct(_any_of(low, ASSIGN_SIGNS).alias("assign"), _any_of(low, LOGIN_SIGNS).alias("login")))
    return _with(named, lambda has: F.array_sort(F.concat(
        _where(has["assign"] & t.rlike(ASSIGN), _assigned(t)), _where(F.contains(t, F.lit(ACCESS_SIGN)), _access(t)),
        _where(t.rlike(long_hex), _spans(t, long_hex, 2)), _where(has["login"] & t.rlike(LOGIN), _spans(t, LOGIN, 5)),
        _where(F.contains(t, F.lit(ENDPOINT_SIGN)) & t.rlike(ENDPOINT), _spans(t, ENDPOINT, 6)))))


def undecided(found: Column) -> Column:
    """Whether a text has a weak candidate and anything else that it could be a part with."""
    return (F.size(found) > 1) & F.exists(found, lambda s: s["rank"] >= 3)


def _part(rank: Column) -> Column:
    """What a kind is of a credential: secret, identifier or endpoint."""
    return F.when(rank.isin(0, 2, 3), "secret").when(rank == 6, "endpoint").otherwise("identifier")


def links(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, linked): of rows (row, found), the weak candidates that have a complementary part within ``scope`` code points."""
    one = found.where(undecided(F.col("found"))).select("row", F.explode("found").alias("s")).select("row", "s.start", "s.rank", "s.end").withColumn("part", _part(F.col("rank")))
    weak = one.where("rank >= 3").select(
        "row", "start", "rank", "end", "part",
        F.explode(F.sequence(F.floor(F.greatest(F.col("start") - scope, F.lit(0)) / scope), F.floor((F.col("end") + scope) / scope))).alias("block"))
    other = one.select(
        "row", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("part").alias("p2"),
        F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("block"))
    # a block's spans are one row, so that two blocks full of them are compared without a row per pair
    sides = other.groupBy("row", "block", (F.col("p2") == "secret").alias("secret")).agg(F.collect_set(F.struct("s2", "e2")).alias("near"))
    return (
        weak.join(sides, ["row", "block"]).where((F.col("part") == "secret") != F.col("secret"))
        .where(F.exists("near", lambda s: (s["s2"] <= F.col("end") + scope) & (F.col("start") <= s["e2"] + scope)))
        .groupBy("row").agg(F.collect_set(F.struct("start", "rank", "end")).alias("linked")))


def reported(found: Column, linked: Column) -> Column:
    """Base spans and linked candidates, sorted: array<struct<kind, start, end, base>>."""
    base = F.filter(found, lambda s: s["rank"] < 3)
    every = F.array_sort(F.concat(base, F.coalesce(linked, F.array().cast(f"array<{_SPAN}>"))))
    names = F.array(*map(F.lit, KINDS))
    return F.transform(every, lambda s: F.struct(
        F.element_at(names, s["rank"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (s["rank"] < 3).alias("base")))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, spans array<struct<kind, start, end, base>>), one row per input row, sorted by start and kind.

    Base kinds are assign, access and hex.  A weak span is added if a complementary part is in the same document
    with at most ``scope`` code points between them: for an identifier or an endpoint a secret, for a secret an
    identifier or an endpoint.  Null and empty texts have no spans; null and repeated ids are rows like any other;
    extra columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    found = kept(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), found_in(F.col(text)).alias("found")))
    linked = kept(links(found, scope))
    return found.join(small(linked), "row", "left").select("id", reported(F.col("found"), F.col("linked")).alias("spans"))


def without_secrets(docs: DataFrame, text: str = "text", length: str = "n_chars", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span replaced by a mark, and ``length`` set anew where one was.

    Only texts with a weak candidate that is not decided by itself wait for the linking; all others pass straight on.
    """
    prepare(docs.sparkSession)
    rows = kept(docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__found", found_in(F.col(text))))
    linked = kept(links(rows.select(F.col("__row").alias("row"), F.col("__found").alias("found")), scope).select(F.col("row").alias("__row"), F.col("linked").alias("__linked")))
    waiting = undecided(F.col("__found"))
    plain = rows.where(~waiting).withColumn("__linked", F.array().cast(f"array<{_SPAN}>"))
    both = plain.unionByName(rows.where(waiting).join(small(linked), "__row", "left").select(*rows.columns, "__linked"))
    both = both.withColumn("__spans", reported(F.col("__found"), F.col("__linked")))
    cut = F.when(F.size("__spans") > 0, redact(F.col(text), F.col("__spans"))).otherwise(F.col(text))
    done = both.withColumn(text, cut)
    if length in docs.columns:
        done = done.withColumn(length, F.when(F.size("__spans") > 0, F.length(text).cast("long")).otherwise(F.col(length)))
    return done.select(*docs.columns)


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with the spans, sorted by start, replaced by ``mark``; spans that overlap become one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        spans, start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
            .otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
