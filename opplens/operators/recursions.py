"""Recursions along a series without a task for a whole series: rows are cut into blocks of time, a block is summarised by one row, and
what a block begins with follows from the summaries of those before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks whose maps are composed in one group; beyond that, groups of blocks are blocks again.
FAN_IN = 64


def block_of(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)


def running(rows: DataFrame, by: list[str], order: str, block: int | Column, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, tops: dict[str, Column] | None = None) -> DataFrame:
    """rows with sums up to and with each row, and the last values that are not NULL and the greatest values before each row, along order.

    Windows go over the rows of a block, of so many seconds or as a column says, and over one row a block."""
    sums, lasts, tops = sums or {}, lasts or {}, tops or {}
    made = {**sums, **lasts, **tops}
    x = rows.withColumn("__block", block if isinstance(block, Column) else block_of(order, block)).withColumns({f"__{n}": c for n, c in made.items()})
    totals = x.groupBy(*by, "__block").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sums], *[F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), F.col(order))).alias(f"__{n}") for n in lasts], *[F.max(f"__{n}").alias(f"__{n}") for n in tops])
    over = {**dict.fromkeys(sums, F.sum), **dict.fromkeys(lasts, lambda c: F.last(c, ignorenulls=True)), **dict.fromkeys(tops, F.max)}
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(*by, "__block", *[over[n](f"__{n}").over(before).alias(f"__head_{n}") for n in made])
    inside = Window.partitionBy(*by, "__block").orderBy(order)
    earlier = {n: over[n](f"__{n}").over(inside.rowsBetween(Window.unboundedPreceding, -1)) for n in (*lasts, *tops)}
    found = x.join(heads, [*by, "__block"]).withColumns({
        **{n: F.coalesce(F.col(f"__head_{n}"), F.lit(0)) + F.coalesce(F.sum(f"__{n}").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) for n in sums},
        **{n: F.coalesce(earlier[n], F.col(f"__head_{n}")) for n in lasts}, **{n: F.greatest(earlier[n], F.col(f"__head_{n}")) for n in tops},
    })
    return found.select(*[c for c in rows.columns if c not in made], *made)


def _composed(first: Column, second: Column, names: list[str]) -> Column:
    """The map x -> a x + b of second after first, for each of names, with one a."""
    return F.struct((first["a"] * second["a"]).alias("a"), *[(second["a"] * first[n] + second[n]).alias(n) for n in names])


def _prefixes(maps: Column, names: list[str]) -> Column:
    """For each element of an array of maps the composition of all up to it."""
    same = F.struct(F.lit(1.0).alias("a"), *[F.lit(0.0).alias(n) for n in names])
    pick = lambda m: F.struct(m["a"].alias("a"), *[m[n].alias(n) for n in names])
    done = F.aggregate(maps, F.array(same), lambda seen, m: F.concat(seen, F.array(_composed(F.element_at(seen, -1), pick(m), names))))
    return F.slice(done, 2, F.size(maps))


def _starts(maps: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """(by, block, the values before the block) for block maps (by, block, a, names), by a scan of FAN_IN maps at a time."""
    lo, hi = maps.agg(F.min("block"), F.max("block")).first()
    deeper = lo is not None and hi - lo >= FAN_IN
    groups = maps.withColumn("__group", F.floor(F.col("block") / FAN_IN) if deeper else F.lit(0))
    packed = groups.groupBy(*by, "__group").agg(F.array_sort(F.collect_list(F.struct("block", "a", *names))).alias("maps")).withColumn("done", _prefixes(F.col("maps"), names))
    if deeper:
        above = packed.select(*by, F.col("__group").alias("block"), F.element_at("done", -1).alias("m")).select(*by, "block", "m.*")
        heads = _starts(above, by, names).select(*by, F.col("block").alias("__group"), F.struct(*names).alias("head"))
        packed = packed.join(heads, [*by, "__group"])
    else:
        packed = packed.withColumn("head", F.struct(*[F.lit(0.0).alias(n) for n in names]))
    reached = lambda m: [(m["a"] * F.col("head")[n] + m[n]).alias(n) for n in names]
    same = F.struct(F.lit(1.0).alias("a"), *[F.lit(0.0).alias(n) for n in names])
    each = F.transform("maps", lambda m, i: F.struct(m["block"].alias("block"), *reached(F.when(i == 0, same).otherwise(F.get(F.col("done"), i - 1)))))
    return packed.select(*by, F.inline(each))


def affine(rows: DataFrame, by: list[str], ts: str, seconds: int, a: Column, b: dict[str, Column]) -> DataFrame:
    """rows with x = a * (x of the row before) + b along ts for each name in b, starting from 0; a row whose a is NULL changes nothing.

    The map of a block is the composition of its rows' maps, and blocks are composed by a scan over groups of blocks, so no task
    sees more than a block or FAN_IN maps. A block of that many seconds should hold some dozens of rows."""
    names = list(b)
    one = F.struct(F.col(ts).alias("at"), F.coalesce(a, F.lit(1.0)).alias("a"), *[F.when(a.isNull(), 0.0).otherwise(F.coalesce(c, F.lit(0.0))).alias(n) for n, c in b.items()], F.struct(*[c for c in rows.columns if c not in names]).alias("row"))
    packed = rows.groupBy(*by, block_of(ts, seconds).alias("block")).agg(F.array_sort(F.collect_list(one)).alias("rows")).withColumn("done", _prefixes(F.col("rows"), names))
    maps = packed.select(*by, "block", F.element_at("done", -1).alias("m")).select(*by, "block", "m.*")
    heads = _starts(maps, by, names).select(*by, "block", F.struct(*names).alias("head"))
    each = F.transform("rows", lambda r, i: F.struct(r["row"].alias("row"), *[(F.get(F.col("done"), i)["a"] * F.col("head")[n] + F.get(F.col("done"), i)[n]).alias(n) for n in names]))
    return packed.join(heads, [*by, "block"]).select(F.inline(each)).select("row.*", *names)


def wilder_rsi(rows: DataFrame, n: int = 14, seconds: int = 64 * 3600) -> DataFrame:
    """rows (symbol, bar_ts, c) with rsi by Wilder's recursion: mean gain and loss of the first n moves, then each new move weighs 1 / n.
    50 where nothing moved; NULL before n moves."""
    x = running(rows, ["symbol"], "bar_ts", seconds, lasts={"p": F.col("c")}).withColumn("move", F.col("c") - F.col("p"))
    x = running(x, ["symbol"], "bar_ts", seconds, sums={"moves": F.col("move").isNotNull().cast("long")})
    a = F.when(F.col("move").isNotNull(), F.when(F.col("moves") <= n, 1.0).otherwise((n - 1) / n))
    x = affine(x, ["symbol"], "bar_ts", seconds, a, {"up": F.greatest("move", F.lit(0.0)) / n, "down": F.greatest(-F.col("move"), F.lit(0.0)) / n})
    both = F.col("up") + F.col("down")
    return x.withColumn("rsi", F.when(F.col("moves") >= n, F.when(both > 1e-12, 100 * F.col("up") / both).otherwise(50.0))).drop("p", "move", "moves", "up", "down")


#: The limits of the fan, and its phases by number.
FAN = {"window": 12, "spread": 3.0, "expansion": 4.0, "higher_low": 1.5, "max_age": 72, "entry2_after": 1, "direct": True}
IDLE, FIRST_CROSS, RETEST, CONFIRM, ENTRY2, ENTRY3, COMPLETE = range(7)


def fan_origins(rows: DataFrame, seconds: int = 64 * 3600, rules: dict = FAN) -> DataFrame:
    """rows (symbol, bar_ts, rsi, ema, wma) once for each side, with their number k, whether the line crosses ema and wma, and the number
    of the last origin at or before them. The SHORT side is the LONG one of the mirrored lines."""
    x = running(rows, ["symbol"], "bar_ts", seconds, sums={"k": F.lit(1).cast("long")}, lasts={f"{c}_p": F.col(c) for c in ("rsi", "ema", "wma")})
    sides = x.withColumn("s", F.explode(F.array(F.lit(1.0), F.lit(-1.0)))).withColumns({c: F.col(c) * F.col("s") for c in ("rsi", "ema", "wma", "rsi_p", "ema_p", "wma_p")})
    up = lambda a, b: F.coalesce((F.col(f"{a}_p") <= F.col(f"{b}_p")) & (F.col(a) > F.col(b)), F.lit(False))
    down = lambda a, b: F.coalesce((F.col(f"{a}_p") >= F.col(f"{b}_p")) & (F.col(a) < F.col(b)), F.lit(False))
    y = sides.select("symbol", "bar_ts", F.when(F.col("s") > 0, "LONG").otherwise("SHORT").alias("side"), "k", "rsi", "ema", "wma", (F.greatest("rsi", "ema", "wma") - F.least("rsi", "ema", "wma")).alias("span"), up("rsi", "ema").alias("over_ema"), up("rsi", "wma").alias("over_wma"), down("rsi", "wma").alias("under"), down("ema", "wma").alias("falls"))
    by = ["symbol", "side"]
    y = running(y, by, "bar_ts", seconds, lasts={"crossed": F.when(F.col("under"), F.col("k"))})
    # a cross of this very bar sets the age to 0, which is no origin
    origin = F.col("falls") & ~F.col("under") & (F.col("k") - F.col("crossed")).between(1, rules["window"]) & (F.col("span") <= rules["spread"])
    y = y.withColumn("own", F.when(F.coalesce(origin, F.lit(False)), F.col("k")))
    y = running(y, by, "bar_ts", seconds, lasts={"earlier": F.col("own")})
    return y.withColumn("origin", F.coalesce("own", "earlier")).drop("own", "earlier", "crossed", "under", "falls")


def fan_trackers(rows: DataFrame, seconds: int = 64 * 3600, rules: dict = FAN) -> DataFrame:
    """A row for each origin of a fan: the bars of its entries 1 to 3, how it ended, its age and its greatest span.

    An origin starts the machine anew whatever its state was, and it lives max_age bars at most, so the machine runs over the bars
    from an origin to before the next one or to that age: a bounded group, in which a fold carries the seven phases."""
    x = fan_origins(rows, seconds, rules).where((F.col("k") - F.col("origin")).between(0, rules["max_age"] + 1))
    bar = F.struct("k", "bar_ts", "rsi", "ema", "wma", "span", "over_ema", "over_wma")
    groups = x.groupBy("symbol", "side", "origin").agg(F.array_sort(F.collect_list(bar)).alias("bars"))
    never = F.lit(None).cast("timestamp_ntz" if dict(rows.dtypes)["bar_ts"] == "timestamp_ntz" else "timestamp")
    head = F.element_at("bars", 1)
    start = F.struct(F.lit(FIRST_CROSS).alias("phase"), F.lit(0).alias("age"), F.lit(0).alias("since"), head["rsi"].alias("first"), head["rsi"].alias("retest"), F.lit(0.0).alias("entry"), head["span"].alias("span"), never.alias("e1"), never.alias("e2"), never.alias("e3"), F.lit(None).cast("string").alias("ended"))

    def step(s: Column, r: Column) -> Column:
        live = ~s["phase"].isin(IDLE, COMPLETE)
        age, low = s["age"] + 1, r["rsi"] <= r["ema"]
        over, direct = r["over_wma"], r["over_wma"] & F.lit(rules["direct"])
        span = F.greatest(s["span"], r["span"])
        retest = F.when(low, F.least(s["retest"], r["rsi"])).otherwise(s["retest"])
        between = (r["rsi"] > r["ema"]) & (r["rsi"] <= r["wma"]) & (r["rsi"] > s["entry"])
        phase = (
            F.when(~live, s["phase"]).when(age > rules["max_age"], IDLE)
            .when(s["phase"] == FIRST_CROSS, F.when(span < rules["expansion"], FIRST_CROSS).when(direct, COMPLETE).when(r["over_ema"], RETEST).otherwise(FIRST_CROSS))
            .when(s["phase"] == RETEST, F.when(direct, COMPLETE).when(low, CONFIRM).otherwise(RETEST))
            .when(s["phase"] == CONFIRM, F.when(direct, COMPLETE).when(r["over_ema"], F.when(retest >= s["first"] + rules["higher_low"], ENTRY2).otherwise(IDLE)).otherwise(CONFIRM))
            .when(s["phase"] == ENTRY2, F.when(over, COMPLETE).when((s["since"] + 1 >= rules["entry2_after"]) & between, ENTRY3).otherwise(ENTRY2))
            .otherwise(F.when(over, COMPLETE).otherwise(ENTRY3))
        )

        def moved(p: Column) -> Column:
            to = lambda frm, into: (s["phase"] == frm) & (p == into)
            expired = live & (age > rules["max_age"])
            return F.struct(
                p.alias("phase"), F.when(live, age).otherwise(s["age"]).alias("age"), F.when(to(CONFIRM, ENTRY2), 0).when(s["phase"] == ENTRY2, s["since"] + 1).otherwise(s["since"]).alias("since"),
                F.when((s["phase"] == FIRST_CROSS) & ~expired, F.least(s["first"], r["rsi"])).otherwise(s["first"]).alias("first"), F.when(to(FIRST_CROSS, RETEST) | to(RETEST, CONFIRM), r["rsi"]).when(s["phase"] == CONFIRM, retest).otherwise(s["retest"]).alias("retest"),
                F.when(to(CONFIRM, ENTRY2), r["rsi"]).otherwise(s["entry"]).alias("entry"), F.when(live & ~expired, span).otherwise(s["span"]).alias("span"),
                F.when(to(CONFIRM, ENTRY2), r["bar_ts"]).otherwise(s["e1"]).alias("e1"), F.when(to(ENTRY2, ENTRY3), r["bar_ts"]).otherwise(s["e2"]).alias("e2"), F.when(live & (p == COMPLETE), r["bar_ts"]).otherwise(s["e3"]).alias("e3"),
                F.when(expired, "EXPIRED").when(to(CONFIRM, IDLE), "INVALID").when(live & (p == COMPLETE), "COMPLETE").otherwise(s["ended"]).alias("ended"),
            )

        return F.get(F.transform(F.array(phase), moved), F.lit(0))  # the next phase is worked out once

    last = F.aggregate(F.slice("bars", 2, rules["max_age"] + 1), start, step)
    done = groups.select("symbol", "side", "origin", F.element_at("bars", 1)["bar_ts"].alias("origin_ts"), F.element_at("bars", -1)["k"].alias("last_k"), last.alias("m"))
    again = F.lead("origin").over(Window.partitionBy("symbol", "side").orderBy("origin"))  # one row an origin
    ended = F.coalesce(F.col("m.ended"), F.when(F.col("last_k") + 1 == again, "RESTARTED").otherwise("OPEN"))
    return done.select("symbol", "side", "origin_ts", F.col("m.e1").alias("entry1"), F.col("m.e2").alias("entry2"), F.col("m.e3").alias("entry3"), ended.alias("ended"), F.col("m.age").alias("age"), F.col("m.span").alias("max_span"))
