"""How the sources of a language differ from each other and from the language, in the words they use.

Terms are runs of letters A-Z and of characters beyond ASCII; only A-Z are lower-cased. A language keeps the terms that stand in at least ``least_documents`` of
its documents. A group (lang, source), and each language, gives each kept term the integer share 1 + floor(10^9 (count + 2) / (N + 2 V)); two shares p and q
diverge by floor((p - q)^2 / (p + q)).

Shares of a group are a vector over the kept terms. These are dealt into blocks, the sources of a language into teams; a *seat* holds the compressed vectors of one
team in one block, and stays where it is: seats are a table bucketed by block and team. In the rounds of a round-robin tournament (circle method) each team's vectors visit
one other team's seats, the only rows that are exchanged; a meeting evaluates all sources of both teams, in both directions, and a home round
those within a team. Blocks add up. Each seat also ranks its terms against the language in heaps of ten, merged at the end.

A seat holds at most about ``seat_entries`` numbers whatever the number of sources or of kept terms, since teams grow with the sources of a language (so
that there are some 32 rounds at most), blocks shrink with the teams, and terms are dealt to blocks by hash. The hot source of a language has one vector, like any other.

Nulls: a null text, lang or source is empty. Empty texts have no terms, but their group occurs. Repeated rows count each. Ties are ranked by item, in the
order of UTF-8. A language without kept terms has pairs of value 0 and no terms, one with one source no pairs. A very long text is split by one task at a time. An empty table gives no
rows. Other columns are ignored, whatever their names. All arithmetic is of integers: shares in decimals of 38 digits, divergences in 64 bits.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import chunks, partitions_for, scratch_path, utf8, written

ONE = 1_000_000_000

#: Bytes of UTF-8 as they count in terms: letters in lower case, other ASCII as a space. Characters beyond ASCII have only bytes from 128 on.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, occurrences bigint, documents bigint"
SEATS = "lang string, block bigint, team int, pack binary, best array<struct<no: int, value: bigint, term: string>>"
MEETINGS = "lang string, a int, b int, value bigint"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def counted(batches: Iterator[pa.RecordBatch], most_held: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Rows of ``COUNTS`` of a task's texts; about ``most_held`` terms are held, so a term of a group may come more than once."""
    held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (seen, within) in held.items():
            columns = [[lang] * (len(seen) + 1), [source] * (len(seen) + 1), [None, *seen]]
            numbers = [[0, *seen.values()], [0, *map(within.__getitem__, seen)]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.binary()).cast(pa.string()) for c in columns], *[pa.array(c, pa.int64()) for c in numbers]], names=[c.split()[0] for c in COUNTS.split(", ")])
        held.clear()

    for batch in batches:
        for piece in chunks([batch], "text", 16 << 20):
            groups: dict[tuple[bytes, bytes], list[bytes]] = {}  # one group after the other, whose counters then stay in the processor's cache
            for lang, source, text in zip(*[utf8(piece.column(c)) for c in ("lang", "source", "text")], strict=True):
                groups.setdefault((lang, source), []).append(text)
            for group, texts in groups.items():
                seen, within = held.setdefault(group, (Counter(), Counter()))
                for text in texts:
                    found = terms(text)
                    seen.update(found)
                    within.update(set(found))
            if sum(len(x) for x, _ in held.values()) > most_held:
                yield from flush()
    yield from flush()


def counts(docs: DataFrame, most_held: int = 1_000_000) -> DataFrame:
    """(lang, source, term, occurrences, documents), counted in tasks before anything is exchanged; each group has a row with a null term as well."""
    found = docs.select("lang", "source", "text").mapInArrow(lambda batches: counted(batches, most_held), COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), exact beyond 64 bits; 1 where nothing is kept."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    whole = F.nullif(wide(total + 2 * kept, 20), wide(F.lit(0), 20))
    return 1 + F.coalesce(F.call_function("div", wide(F.lit(ONE), 10) * wide(count + 2, 20), whole), F.lit(0).cast("long"))


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def packed(size: int, vectors: list[tuple[int, int, np.ndarray, np.ndarray]]) -> bytes:
    """Vectors (number, share of terms that don't occur, places, shares) over ``size`` terms, compressed."""
    head = np.array([size, len(vectors), *(x for no, absent, at, _ in vectors for x in (no, absent, len(at)))], "<i8")
    body = [x for _, _, at, p in vectors for x in (at.astype("<i4").tobytes(), p.astype("<i4").tobytes())]
    return zlib.compress(head.tobytes() + b"".join(body), 1)


def unpacked(data: bytes) -> tuple[list[int], np.ndarray]:
    """Numbers of a seat's sources, and a row of shares over all terms of the block for each."""
    data = zlib.decompress(data)
    size, n = np.frombuffer(data, "<i8", 2).tolist()
    heads = np.frombuffer(data, "<i8", 3 * n, 16).reshape(n, 3)
    rows, at = np.repeat(heads[:, 1:2], size, axis=1), 16 + 24 * n
    for row, (_, _, k) in zip(rows, heads.tolist(), strict=True):
        row[np.frombuffer(data, "<i4", k, at)] = np.frombuffer(data, "<i4", k, at + 4 * k)
        at += 8 * k
    return heads[:, 0].tolist(), rows


def seat(table: pa.Table, ranks: int = 10) -> pa.Table:
    """One seat of its rows (lang, block, team, no, slot, p, q, term); a row without a slot stands for a source: p is its share of absent terms, q the block's size."""
    no, slot, p, q = (table.column(c).to_pandas().to_numpy() for c in ("no", "slot", "p", "q"))
    term = table.column("term").cast(pa.binary()).to_pylist()
    marks, vectors, best = np.isnan(slot), [], []
    for i in sorted(np.flatnonzero(marks).tolist(), key=no.__getitem__):
        own = np.flatnonzero((no == no[i]) & ~marks)
        vectors.append((int(no[i]), int(p[i]), slot[own], p[own]))
        above = own[p[own] > q[own]]
        value = divergences(p[above], q[above])
        heap = heapq.nsmallest(ranks, zip((-value).tolist(), map(term.__getitem__, above.tolist()), strict=True))
        best += [{"no": int(no[i]), "value": -v, "term": t.decode()} for v, t in heap]
    first = [table.column(c)[0].as_py() for c in ("lang", "block", "team")]
    size = int(q[marks][0])
    kind = pa.list_(pa.struct([("no", pa.int32()), ("value", pa.int64()), ("term", pa.string())]))
    return pa.table([pa.array([first[0]], pa.string()), pa.array([first[1]], pa.int64()), pa.array([first[2]], pa.int32()), pa.array([packed(size, vectors)], pa.binary()), pa.array([best], kind)], names=["lang", "block", "team", "pack", "best"])


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the task's blocks for both directions of each pair of sources; a seat without a visitor plays its own sources."""
    sums: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(sums)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([sums[k] for k in keys], pa.int64())], names=["lang", "a", "b", "value"])
        sums.clear()
        return out

    for batch in batches:
        for lang, home, away in zip(*[batch.column(c).to_pylist() for c in ("lang", "pack", "visitor")], strict=True):
            names, rows = unpacked(home)
            others, peers = unpacked(away) if away is not None else (names, rows)
            for i, a in enumerate(names):
                first = 0 if away is not None else i + 1
                for b, value in zip(others[first:], divergences(rows[i], peers[first:]).sum(axis=1).tolist(), strict=True):
                    sums[lang, a, b] += value
                    sums[lang, b, a] += value
            if len(sums) > 500_000:
                yield flush()
    yield flush()


def partner(team: Column, teams: Column, turn: int) -> Column:
    """Whom a team meets in a round of the circle method; with an odd number of teams one is to meet the team that isn't there."""
    last = teams + teams % 2 - 1
    across = F.pmod(F.lit(turn) - team, last)
    return F.when(team == last, F.pmod(F.lit(turn) * F.floor((last + 1) / 2), last)).when(across == team, last).otherwise(across).cast("int")


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table, broadcast if it has at most so many rows (of two names and six numbers); else an exchange joins it, whose skew Spark splits."""
    return F.broadcast(df) if df.count() <= most else df


def seats_of(docs: DataFrame, least_documents: int, seat_entries: int, least_team: int) -> tuple[DataFrame, DataFrame]:
    """(sources of all languages with their numbers and teams, seats): see the module."""
    found = written(counts(docs), "counts")
    kept = found.where("term is not null").groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("total")).where(F.col("documents") >= least_documents)
    kept = written(kept.select("lang", "term", "total"), "kept")
    groups = found.where("term is null").select("lang", "source")
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang")), "lang", "left").na.fill(0)
    team = F.greatest(F.lit(least_team), F.ceil(F.col("sources") / 32))
    langs = langs.withColumn("team_size", team).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / F.greatest(F.lit(1), F.least(F.lit(8192), F.floor(F.lit(seat_entries) / F.col("team_size")))))))
    langs = bounded(written(langs.withColumn("teams", F.ceil(F.col("sources") / F.col("team_size"))), "langs"))

    terms_ = kept.join(langs.select("lang", "v", "n_lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    terms_ = terms_.withColumn("slot", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1)
    terms_ = written(terms_.select("lang", "term", "block", "slot", share(F.col("total"), F.col("n_lang"), F.col("v")).alias("q")), "terms")
    entries = written(found.join(terms_, ["lang", "term"]).select("lang", "source", "block", "slot", "occurrences", "q", "term"), "entries")

    totals = entries.groupBy("lang", "source").agg(F.sum("occurrences").alias("n"))
    no = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    members = groups.join(totals, ["lang", "source"], "left").na.fill(0, ["n"]).join(langs, "lang").withColumn("no", no)
    members = members.select("lang", "source", "no", F.floor(F.col("no") / F.col("team_size")).cast("int").alias("team"), F.col("teams").cast("int").alias("teams"), "n", "v", "blocks")
    members = bounded(written(members, "members"))

    whole = ["lang", "block", "team", "no", "slot", "p", "q", "term"]
    present = entries.join(members, ["lang", "source"]).withColumn("p", share(F.col("occurrences"), F.col("n"), F.col("v")))
    sizes = terms_.groupBy("lang", "block").agg(F.count("*").alias("q"))
    marks = members.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(sizes, ["lang", "block"], "left").na.fill(0, ["q"])
    marks = marks.withColumns({"p": share(F.lit(0).cast("long"), F.col("n"), F.col("v")), "slot": F.lit(None).cast("int"), "term": F.lit(None).cast("string")})
    spark = docs.sparkSession
    n = partitions_for(spark, 0, 1)
    dealt = present.select(whole).union(marks.select(whole)).repartition(n, "lang", "block", "team")
    seats = dealt.groupBy("lang", "block", "team").applyInArrow(lambda table: seat(table), SEATS)
    name = f"gridloom_seats_{uuid.uuid4().hex}"
    seats.write.bucketBy(n, "lang", "block", "team").sortBy("lang", "block", "team").option("path", scratch_path(spark, "seats")).saveAsTable(name)
    return members, spark.table(name)


def tournament(seats: DataFrame, members: DataFrame) -> DataFrame:
    """(lang, a, b, value) for all ordered pairs of different sources of a language; a pair's value stands in several rows, which add up."""
    teams = members.select("lang", "teams").distinct()
    most = teams.agg(F.max("teams")).first()[0] or 1
    seats = seats.select("lang", "block", "team", "pack")
    played = [written(seats.withColumn("visitor", F.lit(None).cast("binary")).select("lang", "pack", "visitor").mapInArrow(meet, MEETINGS), "home")]
    known = seats.join(bounded(written(teams, "teams")), "lang")
    for turn in range(most + most % 2 - 1 if most > 1 else 0):
        against = known.withColumn("host", partner(F.col("team"), F.col("teams"), turn)).where((F.col("host") < F.col("teams")) & (F.lit(turn) < F.col("teams") + F.col("teams") % 2 - 1))
        # of a pair of teams the lower one is at home if their sum is odd, so that all are hosts about as often
        away = F.when((F.col("team") + F.col("host")) % 2 == 1, F.col("team") > F.col("host")).otherwise(F.col("team") < F.col("host"))
        visitors = against.where(away).select("lang", "block", F.col("host").alias("team"), F.col("pack").alias("visitor"))
        met = seats.join(visitors, ["lang", "block", "team"]).select("lang", "pack", "visitor")
        played.append(written(met.mapInArrow(meet, MEETINGS), f"round-{turn}"))
    return reduce(DataFrame.union, played)


def divergence(docs: DataFrame, least_documents: int = 10, ranks: int = 10, seat_entries: int = 1 << 18, least_team: int = 4) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: all other sources of the language; ``term``: the ``ranks`` (at most ten) terms that most set the group apart."""
    if not 1 <= ranks <= 10:
        raise ValueError("one to ten ranks")
    members, seats = seats_of(docs, least_documents, seat_entries, least_team)
    of = lambda no, source: members.select("lang", F.col("no").alias(no), F.col("source").alias(source))
    sums = tournament(seats, members).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = sums.join(of("a", "source"), ["lang", "a"]).join(of("b", "item"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    best = seats.select("lang", F.explode("best").alias("x")).select("lang", F.col("x.no").alias("no"), F.col("x.term").alias("item"), F.col("x.value").alias("value"))
    told = best.join(of("no", "source"), ["lang", "no"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(told.withColumn("rank", rank).where(F.col("rank") <= ranks))
