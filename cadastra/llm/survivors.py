"""Best representative of each duplicate group (problem 1), by token-level consensus.

The values of a group are aligned progressively: each value joins a profile whose columns count weighted
tokens, the columns vote, and the existing value closest to the voted tokens stands for the group. Equal values are
counted first (``groupBy`` with map-side combine). A group of at most ``MOST`` distinct values is one small task's list;
of a larger one, partial profiles are made from parts of about ``MOST`` values, and merge like values do, ``MOST`` at a time,
so a group is never gathered whole.

The rows of one file stem are queued for one rendition if their accounts agree. All their accounts vote, whole,
damaged or read from the stem, digit by digit after alignment; the stem's account is the voted one if every whole account
lies within one edit of it. So rows of which none shows the whole account still find the rows of other stems that do.
Rows with damaged or missing accounts or years take over what their stem has voted; other rows carry their own.
``representatives`` lets account, time and status of a rendition vote over all of its rows.

Defined results: rows without account, year and voted stem stay alone; NULL or unknown statuses have the
lowest trust; unreadable times are the oldest; ties go to the smallest queue_id; exact copies under new ids count
as rows; empty input gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.session import checkpointed, flat_map

#: Distinct values, or partial profiles, of one group that one task aligns at a time, about.
MOST = 64
#: Merges of partial profiles: a group of MOST ** (MERGES + 1) distinct values still takes lists of about MOST.
MERGES = 3
GAP, UNKNOWN = "", "?"
#: Scores of a column without a partner and of two that differ, which is less bad than two without partners.
OPEN, MISMATCH = -0.4, -0.7
Profile = list[dict[str, float]]


# --- consensus -------------------------------------------------------------------------------------------------


def align(a: Profile, b: Profile) -> Profile:
    """Needleman-Wunsch alignment of two profiles, merged column by column; unpaired columns count gaps.

    A column with an unreadable token pairs with any other about half as well as with its like.
    """
    if not a or not b:
        return a or b
    wa = sum(a[0].values())
    wb = sum(b[0].values())
    n, m = len(a), len(b)
    if n == m and all(x.keys() == y.keys() for x, y in zip(a, b, strict=True)):  # equal columns pair up as they are
        return [{t: w + y[t] for t, w in x.items()} for x, y in zip(a, b, strict=True)]
    # undisputed equal columns at either end pair up in a best alignment
    low, high = 0, 0
    while low < n and low < m and len(a[low]) == 1 and a[low].keys() == b[low].keys():
        low += 1
    while high < min(n, m) - low and len(a[-1 - high]) == 1 and a[-1 - high].keys() == b[-1 - high].keys():
        high += 1
    if low or high:
        same = lambda x, y: [{t: w + q[t] for t, w in p.items()} for p, q in zip(x, y, strict=True)]
        middle = _aligned(a[low : n - high], b[low : m - high], wa, wb)
        return same(a[:low], b[:low]) + middle + same(a[n - high :], b[m - high :])
    return _aligned(a, b, wa, wb)


def _aligned(a: Profile, b: Profile, wa: float, wb: float) -> Profile:
    """``align`` of profiles of weights ``wa`` and ``wb``, cell by cell."""
    n, m = len(a), len(b)
    gap = OPEN
    score = [[j * gap for j in range(m + 1)]]
    move: list[list[int]] = [[2] * (m + 1)]
    for i in range(1, n + 1):
        row, steps, above = [i * gap], [1], score[-1]
        ca = a[i - 1]
        lone = next(iter(ca)) if len(ca) == 1 else None
        for j in range(1, m + 1):
            cb = b[j - 1]
            if lone is not None:
                same = cb.get(lone, 0.0) / wb if lone != GAP else 0.0
            else:
                same = 0.0
                for t, w in ca.items():
                    if t in cb and t != GAP:
                        same += min(w / wa, cb[t] / wb)
            if same < 0.5 and (UNKNOWN in ca or UNKNOWN in cb):
                same = 0.5
            best, step = above[j - 1] + max(2 * same - 1, MISMATCH), 0
            if above[j] + gap > best:
                best, step = above[j] + gap, 1
            if row[j - 1] + gap > best:
                best, step = row[j - 1] + gap, 2
            row.append(best)
            steps.append(step)
        score.append(row)
        move.append(steps)
    merged: Profile = []
    i, j = n, m
    while i or j:
        step = move[i][j] if i and j else (1 if i else 2)
        ca = a[i - 1] if step != 2 else {GAP: wa}
        cb = b[j - 1] if step != 1 else {GAP: wb}
        column = dict(ca)
        for t, w in cb.items():
            column[t] = column.get(t, 0.0) + w
        merged.append(column)
        i -= step != 2
        j -= step != 1
    return merged[::-1]


def profile_of(values: list[tuple[list[str], float]]) -> Profile:
    """The profile of weighted token lists, aligned progressively from the heaviest, ties in token order."""
    profile: Profile = []
    for tokens, weight in sorted(values, key=lambda v: (-v[1], v[0])):
        if tokens and weight > 0:
            profile = align(profile, [{t: weight} for t in tokens])
    return profile


def vote(profile: Profile) -> list[str]:
    """The heaviest token of each column, columns won by the gap left out; ties go to the smaller token, then the gap.

    An unreadable token has no vote where a readable one stands.
    """
    winners = []
    for column in profile:
        readable = [t for t in column if t not in (UNKNOWN, GAP)] or [UNKNOWN]
        winners.append(min(readable + [GAP] * (GAP in column), key=lambda t: (-column[t], t == GAP, t)))
    return [t for t in winners if t != GAP]


def voted_tokens(values: list[tuple[list[str], float]]) -> list[str]:
    """What weighted token lists vote.

    A list that outweighs all others together wins every column however they are aligned, so it stands as it is, unless it
    has unreadable tokens, which leave the vote to the others.
    """
    top, weight = max(values, key=lambda v: v[1])
    if 2 * weight > sum(w for _, w in values) and UNKNOWN not in top:
        return top
    return vote(profile_of(values))


def distance(a: list[str], b: list[str]) -> int:
    """Edit distance of two token lists; equal ends cost nothing in a best alignment and are left out of it."""
    if a == b:
        return 0
    low, high, least = 0, 0, min(len(a), len(b))
    while low < least and a[low] == b[low]:
        low += 1
    while high < least - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not a or not b:
        return len(a) + len(b)
    # a column of the table at a time, its differences as bits
    at: dict[str, int] = {}
    for i, token in enumerate(a):
        at[token] = at.get(token, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = mask, 0, len(a)
    for token in b:
        equal = at.get(token, 0)
        vertical = equal | down
        equal = (((equal & up) + up) ^ up) | equal
        plus, minus = down | ~(equal | up), up & equal
        score += 1 if plus & top else -1 if minus & top else 0
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(vertical | plus)) & mask, plus & vertical & mask
    return score


def words(value: str) -> list[str]:
    return re.findall(r"\w+|[^\w\s]", value.lower())


#: Letters that a digit is misread as (fixed values), and marks of unreadable ones.
_MISREAD = str.maketrans("OILZSGB*", "0112568?")


def account_characters(value: str) -> list[str]:
    """The digits of an account without its leading letter; misread ones as digits, unreadable ones as ``?``."""
    shown = [c for c in value.upper() if c.isalnum() or c in "*?"]
    if len(shown) > 8 and shown[0].isalpha() or len(shown) < 8 and shown and shown[0] in "PRB":
        shown = shown[1:]
    return list("".join(shown).translate(_MISREAD))


def consensus(df: DataFrame, group: str, value: str, tokens: Callable[[str], list[str]], weight: Column | None = None, firm: Column | None = None, most_firm: int | None = None, most: int = MOST) -> DataFrame:
    """(group, value, voted, apart): of each group's values, the existing one closest to the consensus of their tokens.

    ``voted`` are the voted tokens run together (NULL where all values of the group are one), ``apart`` is the largest
    distance of a ``firm`` value from them. NULL and blank values have no vote; a group with no other value is left out,
    and so is one with more than ``most_firm`` different firm values, which the caller knows too many to agree. Ties go
    to the value of more weight, then to the smaller one.
    """
    present = df.where(F.col(group).isNotNull() & (F.trim(value) != "")).select(
        F.col(group).alias("g"), F.col(value).alias("v"), (F.lit(1.0) if weight is None else weight).cast("double").alias("w"), (F.lit(False) if firm is None else firm).alias("f")
    )
    counted = checkpointed(present.groupBy("g", "v").agg(F.sum("w").alias("w"), F.max("f").alias("f")))  # read by three branches
    stats = counted.groupBy("g").agg(F.count("*").alias("n"), F.count_if("f").alias("firm"), F.min("v").alias("v"))
    alone = stats.where("n = 1").select("g", "v", F.lit(None).cast("string").alias("voted"), F.lit(0).alias("apart"))
    several = stats.where("n > 1") if most_firm is None else stats.where((F.col("n") > 1) & (F.col("firm") <= most_firm))
    lists = counted.join(several.where(F.col("n") <= most).select("g"), "g").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("w", "v", "f"))).alias("values"))

    def measured(values: list[dict], best: list[str]) -> tuple[str, int]:
        far, closest = 0, None
        for x in values:
            d = distance(tokens(x["v"]), best)
            far = max(far, d) if x["f"] else far
            closest = min(closest, (d, -x["w"], x["v"])) if closest else (d, -x["w"], x["v"])
        return closest[2], far

    def choose(columns: list[list]) -> list[list]:
        out: list[list] = [columns[0], [], [], []]
        for values in columns[1]:
            best = voted_tokens([(tokens(x["v"]), x["w"]) for x in values])
            closest, far = measured(values, best)
            for c, x in zip(out[1:], (closest, "".join(best), far), strict=True):
                c.append(x)
        return out

    small = flat_map(lists, choose, "g STRING, v STRING, voted STRING, apart INT")
    chosen = alone.unionByName(small).unionByName(_of_large(counted.join(several.where(F.col("n") > most).select("g", "n"), "g"), tokens, most))
    return chosen.select(F.col("g").alias(group), F.col("v").alias(value), "voted", "apart")


def _of_large(counted: DataFrame, tokens: Callable[[str], list[str]], most: int) -> DataFrame:
    """The consensus of groups with more than ``most`` distinct values, from partial profiles; ``counted`` has their number ``n``."""
    column = "ARRAY<STRUCT<t: ARRAY<STRING>, w: ARRAY<DOUBLE>>>"

    def pack(profile: Profile) -> list[dict]:
        return [{"t": list(c), "w": list(c.values())} for c in profile]

    def partial(columns: list[list]) -> list[list]:
        return [columns[0], columns[1], columns[2], [pack(profile_of([(tokens(v["v"]), v["w"]) for v in values])) for values in columns[3]]]

    def merge(columns: list[list]) -> list[list]:
        merged = []
        for parts in columns[3]:
            profiles = [[dict(zip(c["t"], c["w"], strict=True)) for c in p["p"]] for p in parts]
            whole: Profile = []
            for p in sorted(profiles, key=lambda p: (-sum(p[0].values()) if p else 0, str(p))):
                whole = align(whole, p)
            merged.append(pack(whole))
        return [columns[0], columns[1], columns[2], merged]

    state = f"g STRING, s BIGINT, k BIGINT, p {column}"
    fewer = lambda n: F.ceil(F.col(n) / most)
    lists = counted.groupBy("g", F.pmod(F.xxhash64("v"), fewer("n")).alias("s"), fewer("n").alias("k")).agg(F.array_sort(F.collect_list(F.struct("w", "v"))).alias("values"))
    parts = flat_map(lists, partial, state)
    for level in range(MERGES):
        k = fewer("k") if level < MERGES - 1 else F.lit(1).cast("bigint")
        parts = flat_map(parts.groupBy("g", F.pmod("s", k).alias("s2"), k.alias("k2")).agg(F.collect_list(F.struct("p")).alias("parts")), merge, state)

    def ballot(columns: list[list]) -> list[list]:
        return [columns[0], [vote([dict(zip(c["t"], c["w"], strict=True)) for c in p]) for p in columns[1]]]

    best = flat_map(parts.select("g", "p"), ballot, "g STRING, best ARRAY<STRING>")

    def nearest(columns: list[list]) -> list[list]:
        g, v, w, f, best = columns
        far = [distance(tokens(x), b) for x, b in zip(v, best, strict=True)]
        return [g, v, w, f, far, ["".join(b) for b in best]]

    apart = flat_map(counted.join(best, "g").select("g", "v", "w", "f", "best"), nearest, "g STRING, v STRING, w DOUBLE, f BOOLEAN, d INT, voted STRING")
    closest = apart.groupBy("g").agg(F.min(F.struct("d", (-F.col("w")).alias("nw"), "v")).alias("m"), F.first("voted").alias("voted"), F.coalesce(F.max(F.when(F.col("f"), F.col("d"))), F.lit(0)).alias("apart"))
    return closest.select("g", F.col("m.v").alias("v"), "voted", "apart")


# --- the fields of the queue -----------------------------------------------------------------------------------


def account_digits(account: Column) -> Column:
    """The eight digits of an account that shows all of them, else NULL."""
    shape = r"(?i)^\s*(?:acct\.?|account|no\.?|#|:|\s)*([a-z])?[-\s]*(\d{4})[-\s]?(\d{4})\s*$"
    return F.when(account.rlike(shape), F.regexp_replace(account, r"\D", ""))


def year_of(text: Column) -> Column:
    """The tax year in a text: ``2021``, ``TY2021``, ``2021.0`` or ``'21``."""
    long, short = F.regexp_extract(text, r"(?<!\d)((?:19|20)\d\d)(?!\d)", 1), F.regexp_extract(text, r"^\s*(?i:ty)?\s*['’](\d\d)\s*$", 1)
    return F.coalesce(F.nullif(long, F.lit("")), F.concat(F.lit("20"), F.nullif(short, F.lit("")))).cast("int")


def file_stem(name: Column) -> Column:
    """The name of a file without folder, extension, copy marks and spelling of its blanks."""
    text = F.regexp_replace(F.lower(F.trim(name)), r"%20|\+", " ")
    for pattern in (r"^.*[\\/]", r"\.(?:pdf|tiff?|png|jpe?g)$", r"^(?:copy of|re|fwd?)[\s:_]+", r"(?:[\s_]*\(\d+\)|[-_ ]resend|[-_ ]copy)+$"):
        text = F.regexp_replace(text, pattern, "")
    return F.nullif(F.regexp_replace(F.trim(text), r"[\s_]+", "_"), F.lit(""))


def read_time(text: Column) -> Column:
    """The instant written in one of the usual forms (naive times are UTC), else NULL."""
    t = F.trim(text)
    third, fifth = F.substring(t, 3, 1), F.substring(t, 5, 1)
    iso = (fifth == "-") & t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$")
    return (
        F.when(iso, F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))
        .when((F.length(t) == 15) & t.rlike(r"^\d{8}T\d{6}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd'T'HHmmss")))
        .when((third == "/") & t.rlike(r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2} [AaPp][Mm]$"), F.try_to_timestamp(F.upper(t), F.lit("MM/dd/yyyy hh:mm:ss a")))
        .when((F.substring(t, 7, 1) == ",") & t.rlike(r"^[A-Z][a-z]{2} \d{2}, \d{4} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(t, F.lit("MMM dd, yyyy HH:mm:ss")))
    )


def status_key(status: Column) -> Column:
    """A status without case, punctuation and surplus blanks."""
    return F.trim(F.regexp_replace(F.lower(status), r"[^a-z0-9]+", " "))


#: Eight digits within one edit of one voted account: 8 * 9 + 1 by a changed digit, 80 in a voted one of seven.
MOST_WHOLE = 80


def renditions(queue: DataFrame, trust: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Every row of the queue with its ``rendition``, the parsed fields the choice needs, and the ``carried`` ones as ``raw_`` columns.

    ``trust`` is the fixed table of statuses (one row per status), so it is broadcast.
    """
    rows = queue.select("queue_id", "account_number", "tax_year", file_stem(F.col("file_name")).alias("stem"), read_time(F.col("processed_at")).alias("at"), status_key(F.col("status")).alias("status_key"), *[F.col(c).alias(f"raw_{c}") for c in carried])
    digits = account_digits(F.col("account_number"))
    rows = rows.select(
        "queue_id",
        digits.alias("digits"),
        F.coalesce(year_of(F.col("tax_year")), F.regexp_extract("stem", r"(?:^|_)(20\d\d)(?:_|$)", 1).try_cast("int")).alias("year"),
        "stem",
        "at",
        F.when(digits.isNull() & F.col("account_number").rlike(r"\d"), F.regexp_replace("account_number", r"(?i)acct|[^A-Za-z0-9*?]", "")).alias("shown"),
        "status_key",
        *[f"raw_{c}" for c in carried],
    )
    ranks = trust.groupBy(status_key(F.col("status")).alias("status_key")).agg(F.max("trust").alias("trust"))
    rows = checkpointed(rows.join(F.broadcast(ranks), "status_key", "left").drop("status_key"))  # parsed once, read by four branches

    # the stems with something to fill in: all accounts and years of their rows vote, and the account that the stem itself shows
    lacking = F.col("digits").isNull() | F.col("year").isNull()
    open_stems = rows.where(F.col("stem").isNotNull() & lacking).select("stem").distinct()
    voters = rows.join(open_stems, "stem", "left_semi")
    own = F.nullif(F.regexp_extract("stem", r"(?<![0-9])(\d{8})(?![0-9])", 1), F.lit(""))
    ballot = lambda kind, value, weight, firm: F.struct(F.concat(F.lit(f"{kind}|"), "stem").alias("ballot"), value.alias("value"), weight.alias("weight"), firm.alias("firm"))
    ballots = F.array(
        ballot("account", F.coalesce("digits", "shown"), F.when(F.col("digits").isNotNull(), 8.0).when(F.length("shown") >= 8, 1.0).otherwise(0.25), F.col("digits").isNotNull()),
        ballot("account", own, F.lit(0.5), F.lit(False)),
        ballot("year", F.col("year").cast("string"), F.lit(1.0), F.lit(True)),
    )
    voted = consensus(voters.select(F.explode(ballots).alias("b")).select("b.*").where("value IS NOT NULL"), "ballot", "value", account_characters, F.col("weight"), F.col("firm"), MOST_WHOLE)
    agreed = voted.where(F.when(F.startswith("ballot", F.lit("year")), F.col("apart") == 0).otherwise(F.col("apart") <= 1))
    of = lambda kind, value: F.max(F.when(F.startswith("ballot", F.lit(kind)), value))
    account = F.coalesce("voted", account_digits(F.col("value")), "value")
    filled = agreed.groupBy(F.substring_index("ballot", "|", -1).alias("stem")).agg(of("account|", account).alias("account_c"), of("year|", F.col("value")).cast("int").alias("year_c"))
    closed = rows.where(~lacking).withColumn("rendition", F.concat_ws("|", "digits", "year"))
    rest = rows.where(lacking).join(filled, "stem", "left")
    whole = F.when(F.col("account_c").rlike(r"^\d{8}$"), F.col("account_c"))
    agrees = F.col("digits").isNull() | whole.isNull() | (F.col("digits") == whole)
    the_account = F.coalesce("digits", F.when(agrees, whole))
    the_year = F.coalesce("year", F.when(agrees, F.col("year_c")), F.when(F.col("digits").isNotNull(), F.year("at")))
    alone = F.when(F.col("account_c").isNotNull(), F.concat_ws("|", F.lit("stem"), "stem", "year_c")).otherwise(F.concat(F.lit("row|"), F.col("queue_id").cast("string")))
    rest = rest.withColumn("rendition", F.coalesce(F.concat(the_account, F.lit("|"), the_year.cast("string")), alone)).select(closed.columns)
    return closed.unionByName(rest)


def _best_rows(rows: DataFrame, of_best: tuple[str, ...] = (), of_shown: tuple[str, ...] = ()) -> DataFrame:
    """(rendition, group_id, survivor_id, account_from) of each rendition with at least two rows, and carried fields of the two rows."""
    oldest = F.coalesce(F.unix_micros("at"), F.lit(-(2**62)))
    first = (-F.col("queue_id")).alias("first")
    shows = F.col("digits").isNotNull() & (F.substring_index("rendition", "|", 1) == F.col("digits"))
    return (
        rows.groupBy("rendition")
        .agg(
            F.min("queue_id").alias("group_id"),
            F.count("*").alias("n"),
            F.max(F.struct(F.coalesce("trust", F.lit(-1)).alias("trust"), oldest.alias("at"), first, *[f"raw_{c}" for c in of_best])).alias("best"),
            F.max(F.when(shows, F.struct(oldest.alias("at"), first, *[f"raw_{c}" for c in of_shown]))).alias("shown"),
        )
        .where("n >= 2")
        .select("rendition", "group_id", (-F.col("best.first")).alias("survivor_id"), (-F.col("shown.first")).alias("account_from"), *[F.col(f"best.raw_{c}").alias(c) for c in of_best], *[F.col(f"shown.raw_{c}").alias(c) for c in of_shown])
    )


def survivors(queue: DataFrame, trust: DataFrame) -> DataFrame:
    """(group_id, survivor_id, account_from) of each rendition with at least two rows in the queue."""
    return _best_rows(renditions(queue, trust)).drop("rendition")


def field_tokens(value: str) -> list[str]:
    """Words, numbers of up to four digits, the single digits of longer ones, and marks of unreadable ones."""
    return re.findall(r"[^\W\d]+|(?<!\d)\d{1,4}(?!\d)|\d|[*?]", value.lower())


FIELDS = ("account_number", "processed_at", "status")


def representatives(queue: DataFrame, trust: DataFrame) -> DataFrame:
    """One record of each rendition with at least two rows: the fields of its best rows and those closest to the consensus.

    account_number, processed_at and status come from the rows ``survivors`` names. ``account_number_closest`` and so on are
    the values of the group that lie closest to what all its rows vote, token by token; they show where the best row
    stands apart from the others. NULL where no row has a value.
    """
    rows = checkpointed(renditions(queue, trust, FIELDS).select("queue_id", "rendition", "digits", "at", "trust", *[f"raw_{f}" for f in FIELDS]))
    found = _best_rows(rows, ("processed_at", "status"), ("account_number",))
    ballots = F.explode(F.array(*[F.struct(F.concat(F.lit(f"{f}|"), "rendition").alias("ballot"), F.col(f"raw_{f}").alias("value")) for f in FIELDS])).alias("b")
    voted = consensus(rows.select(ballots).select("b.*"), "ballot", "value", field_tokens)
    of = lambda f: F.max(F.when(F.startswith("ballot", F.lit(f"{f}|")), F.col("value"))).alias(f"{f}_closest")
    closest = voted.groupBy(F.regexp_replace("ballot", r"^[a-z_]+\|", "").alias("rendition")).agg(*[of(f) for f in FIELDS])
    return found.join(closest, "rendition", "left").select("group_id", "survivor_id", *FIELDS, *[f"{f}_closest" for f in FIELDS])
