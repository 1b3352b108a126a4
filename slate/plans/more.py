"""Further queries: filters with fallbacks, aliases, three-way scores, bands, labels, guards, standings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slate.functions import text
from slate.operators import asof, lookup, overlap, score
from slate.plans import feeds, results, views
from slate.plans.views import AS_OF, GAMES, RINKS, SESSIONS, TEAM_GAMES
from slate.session import table

_NOW = f"CAST('{AS_OF}' AS TIMESTAMP_NTZ)"
_DUCK_NOW = f"TIMESTAMP '{AS_OF}'"
_TIDY = lambda x: f"floor({x} * 1000000 + 0.5) / 1000000.0"


def feed_games(spark: SparkSession, sf: str) -> DataFrame:
    """Weekend games of both local windows: this weekend and the month, within a strict half-hour drive of the home rink."""
    rinks = views.rinks(spark, sf).select(F.col("rink_id").alias("home"), (F.col("drive_minutes") * 60).alias("drive_s"))
    rows = views.games(spark, sf).join(F.broadcast(rinks), "home").where("drive_s > 0 AND drive_s < 1800")
    weekend = F.dayofweek("day").isin(1, 7)
    return rows.where(weekend).groupBy(F.date_trunc("month", "day").cast("date").alias("month"), "division").agg(F.count("*").alias("n"), F.min("drive_s").alias("nearest"))


FEED_GAMES = f"""WITH {GAMES}, {RINKS}
SELECT CAST(date_trunc('month', day) AS DATE) AS month, division, count(*) AS n, min(drive_minutes * 60) AS nearest FROM games JOIN rinks ON rink_id = home
WHERE drive_minutes * 60 < 1800 AND dayofweek(day) IN (0, 6) GROUP BY 1, 2"""


def freshness(spark: SparkSession, sf: str) -> DataFrame:
    """Per source: healthy, stale after 26 hours, unavailable after 48; counts of rows and errors."""
    rows = views.sessions(spark, sf).where(F.col("start_ts") <= F.expr(_NOW)).withColumn("source_id", F.col("ingest_pos") % 50)
    seen = rows.groupBy("source_id").agg(F.max("start_ts").alias("last"), F.count("*").alias("n"), F.count_if(F.col("kind") == "error").alias("errors"))
    age = (F.unix_timestamp(F.expr(_NOW).cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp"))) / 3600
    status = F.when(age > 48, "unavailable").when(age > 26, "stale").otherwise("ok")
    return seen.select("source_id", "n", "errors", status.alias("status"), ((F.col("errors") == 0) | (F.col("n") > 0)).alias("healthy"))


FRESHNESS = f"""WITH {SESSIONS}, seen AS (SELECT ingest_pos % 50 AS source_id, max(start_ts) AS last, count(*) AS n, count(*) FILTER (WHERE kind = 'error') AS errors FROM sessions WHERE start_ts <= {_DUCK_NOW} GROUP BY 1)
SELECT source_id, n, errors, CASE WHEN epoch({_DUCK_NOW} - last) > 48 * 3600 THEN 'unavailable' WHEN epoch({_DUCK_NOW} - last) > 26 * 3600 THEN 'stale' ELSE 'ok' END AS status, errors = 0 OR n > 0 AS healthy FROM seen"""


def slice_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Per rink: the rows tagged A if the rink has tags at all on that day, else all its rows of the day."""
    rows = views.sessions(spark, sf).withColumn("day", F.to_date("start_ts"))
    tagged = rows.groupBy("rink_id", "day").agg(F.count("surface").alias("tags"))
    kept = rows.join(tagged, ["rink_id", "day"]).where((F.col("tags") == 0) | (F.col("surface") == "A"))
    return kept.groupBy("rink_id").agg(F.count("*").alias("n"), F.count_if(F.col("tags") == 0).alias("n_fallback"))


SLICE_WITH_FALLBACK = f"""WITH {SESSIONS}, t AS (SELECT *, count(surface) OVER (PARTITION BY rink_id, CAST(start_ts AS DATE)) AS tags FROM sessions)
SELECT rink_id, count(*) AS n, count(*) FILTER (WHERE tags = 0) AS n_fallback FROM t WHERE tags = 0 OR surface = 'A' GROUP BY rink_id"""


def alias_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Venue texts to venues by exact name or alias, only if one venue has it; else once more without a sheet suffix."""
    supplier = table(spark, sf, "supplier")
    venues = supplier.select("s_suppkey", F.array(text.location_key(F.col("s_name")), F.concat(F.lit("arena "), (F.col("s_suppkey") % 400).cast("string"))).alias("aliases"))
    keys = venues.select("s_suppkey", F.explode("aliases").alias("venue_key"))
    written = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Arena "), (F.col("c_custkey") % 700).cast("string"), F.when(F.col("c_custkey") % 3 == 0, " Rink 2").otherwise(""))).otherwise("TBD")
    rows = table(spark, sf, "customer").select("c_custkey", text.location_key(written).alias("venue_key"))
    retry = F.regexp_replace("venue_key", " (rink|sheet) [0-9a-z]+$", "")
    return lookup.unique_match(rows, keys, "venue_key", "s_suppkey", retry).select("c_custkey", "venue_key", "s_suppkey")


ALIAS_RESOLVE = """WITH keys AS (SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM supplier UNION ALL SELECT s_suppkey, 'arena ' || s_suppkey % 400 FROM supplier),
single AS (SELECT k, any_value(s_suppkey) AS v FROM keys GROUP BY k HAVING count(*) = 1),
r AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'arena ' || c_custkey % 700 || CASE WHEN c_custkey % 3 = 0 THEN ' rink 2' ELSE '' END ELSE 'tbd' END AS venue_key FROM customer)
SELECT c_custkey, venue_key, coalesce(a.v, b.v) AS s_suppkey FROM r LEFT JOIN single a ON a.k = venue_key LEFT JOIN single b ON b.k = regexp_replace(venue_key, ' (rink|sheet) [0-9a-z]+$', '')"""


def cross_season(spark: SparkSession, sf: str) -> DataFrame:
    """Teams of one season to the last by program: the equal level if one has it, else the only candidate."""
    part = table(spark, sf, "part")
    now = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", (F.col("p_partkey") % 60).cast("string")).alias("program"), (F.col("p_size") % 4).alias("level"))
    then = part.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("old_id"), F.concat_ws(" ", "p_brand", (F.col("p_partkey") % 59).cast("string")).alias("program"), (F.col("p_size") % 4).alias("level"))
    exact = lookup.only_unique(then, ["program", "level"], "old_id").withColumnRenamed("old_id", "exact_id")
    sole = lookup.only_unique(then, ["program"], "old_id").withColumnRenamed("old_id", "sole_id")
    joined = now.join(exact, ["program", "level"], "left").join(sole, "program", "left")
    return joined.select("id", F.coalesce("exact_id", "sole_id").alias("old_id"), F.when(F.col("exact_id").isNotNull(), "level").when(F.col("sole_id").isNotNull(), "sole").alias("by"))


CROSS_SEASON = """WITH n AS (SELECT p_partkey AS id, p_brand || ' ' || p_partkey % 60 AS program, p_size % 4 AS level FROM part WHERE p_partkey % 2 = 0),
t AS (SELECT p_partkey AS old_id, p_brand || ' ' || p_partkey % 59 AS program, p_size % 4 AS level FROM part WHERE p_partkey % 2 = 1),
e AS (SELECT program, level, any_value(old_id) AS v FROM t GROUP BY 1, 2 HAVING count(*) = 1), s AS (SELECT program, any_value(old_id) AS v FROM t GROUP BY 1 HAVING count(*) = 1)
SELECT id, coalesce(e.v, s.v) AS old_id, CASE WHEN e.v IS NOT NULL THEN 'level' WHEN s.v IS NOT NULL THEN 'sole' END AS by
FROM n LEFT JOIN e ON e.program = n.program AND e.level = n.level LEFT JOIN s ON s.program = n.program"""


def standings(spark: SparkSession, sf: str) -> DataFrame:
    """Standings with tolerant numbers: games fall back to wins + losses + ties, difference to goals; teams without games get zeros."""
    rec = score.records(views.team_games(views.games(spark, sf)))
    teams = spark.range(views.TEAMS + 4).select(F.col("id").alias("team"))
    given = rec.select("team", F.when(F.col("team") % 3 == 0, "n/a").otherwise(F.col("games").cast("string")).alias("gp"), "wins", "losses", "ties", "gf", "ga")
    zero = lambda c: F.coalesce(c, F.lit(0))
    gp = F.coalesce(F.nullif(F.col("gp").try_cast("long"), F.lit(0)), F.col("wins") + F.col("losses") + F.col("ties"))
    joined = teams.join(given, "team", "left")
    return joined.select("team", zero(gp).alias("gp"), *[zero(F.col(c)).alias(c) for c in ("wins", "losses", "ties")], zero(F.col("gf") - F.col("ga")).alias("gd"), (zero(F.col("wins")) * 2 + zero(F.col("ties"))).alias("points"))


STANDINGS = f"""WITH {GAMES}, {TEAM_GAMES}, rec AS (SELECT team, count(*) AS gp, count(*) FILTER (WHERE half_points = 2) AS wins, count(*) FILTER (WHERE half_points = 0) AS losses, count(*) FILTER (WHERE half_points = 1) AS ties, sum(gf) - sum(ga) AS gd FROM team_games GROUP BY team)
SELECT i.team, coalesce(gp, 0) AS gp, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses, coalesce(ties, 0) AS ties, CAST(coalesce(gd, 0) AS BIGINT) AS gd, coalesce(wins, 0) * 2 + coalesce(ties, 0) AS points
FROM (SELECT unnest(range(0, {views.TEAMS + 4})) AS team) i LEFT JOIN rec ON rec.team = i.team"""


def score_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Scores written `visitor-home` with a hyphen or a dash, read back; other texts give nulls."""
    k = F.col("game_id")
    written = F.when(k % 5 == 0, "postponed").otherwise(F.concat(F.col("away_goals"), F.when(k % 2 == 0, " - ").otherwise("–"), F.col("home_goals")))
    rows = views.games(spark, sf).select("game_id", written.alias("written"))
    part = lambda i: F.regexp_extract("written", r"^\s*(\d+)\s*[-–]\s*(\d+)\s*$", i).try_cast("long")
    return rows.select("game_id", part(1).alias("away_goals"), part(2).alias("home_goals"))


SCORE_PARSE = f"WITH {GAMES} SELECT game_id, CASE WHEN game_id % 5 <> 0 THEN away_goals END AS away_goals, CASE WHEN game_id % 5 <> 0 THEN home_goals END AS home_goals FROM games"


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Signed one-decimal margins, W-L-T records and drive labels."""
    rec = score.records(views.team_games(views.games(spark, sf)))
    tenths = F.floor((F.col("gf") - F.col("ga")) / F.col("games") * 10 + F.lit(0.5)).cast("long")
    digits = F.concat(F.floor(F.abs(tenths) / 10).cast("string"), F.lit("."), (F.abs(tenths) % 10).cast("string"))
    signed = F.when(tenths > 0, F.concat(F.lit("+"), digits)).when(tenths < 0, F.concat(F.lit("−"), digits)).otherwise("±0")
    drive = F.when(F.col("team") * 3 < 30, "<30 min").otherwise(F.concat((F.col("team") * 3).cast("string"), F.lit(" min")))
    return rec.select("team", signed.alias("margin"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("wins", "losses", "ties")]).alias("record"), drive.alias("drive"))


LABELS = f"""WITH {GAMES}, {TEAM_GAMES}, r AS (SELECT team, CAST(floor((sum(gf) - sum(ga)) / CAST(count(*) AS DOUBLE) * 10 + 0.5) AS BIGINT) AS t,
  count(*) FILTER (WHERE half_points = 2) || '-' || count(*) FILTER (WHERE half_points = 0) || '-' || count(*) FILTER (WHERE half_points = 1) AS record FROM team_games GROUP BY team)
SELECT team, CASE WHEN t > 0 THEN '+' || t // 10 || '.' || t % 10 WHEN t < 0 THEN '−' || (-t) // 10 || '.' || (-t) % 10 ELSE '±0' END AS margin, record,
       CASE WHEN team * 3 < 30 THEN '<30 min' ELSE team * 3 || ' min' END AS drive FROM r"""


def calendar_link(spark: SparkSession, sf: str) -> DataFrame:
    """A calendar link per game: encoded title and times, 90 minutes where no end is known."""
    rows = views.games(spark, sf)
    start = F.expr("CAST(day AS TIMESTAMP_NTZ) + make_interval(0, 0, 0, 0, CAST(9 + game_id % 10 AS INT), 0, 0)")
    end = start + F.expr("make_interval(0, 0, 0, 0, 0, CAST(CASE WHEN game_id % 3 = 0 THEN 60 ELSE 90 END AS INT), 0)")
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    title = F.concat(F.lit("Team "), "home", F.lit(" & team "), "away")
    return rows.select("game_id", F.concat(F.lit("text="), F.url_encode(title), F.lit("&dates="), stamp(start), F.lit("/"), stamp(end)).alias("link"))


CALENDAR_LINK = f"""WITH {GAMES}, t AS (SELECT *, CAST(day AS TIMESTAMP) + to_hours(CAST(9 + game_id % 10 AS INT)) AS s FROM games)
SELECT game_id, 'text=Team+' || home || '+%26+team+' || away || '&dates=' || strftime(s, '%Y%m%dT%H%M%SZ') || '/' || strftime(s + to_minutes(CASE WHEN game_id % 3 = 0 THEN 60 ELSE 90 END), '%Y%m%dT%H%M%SZ') AS link FROM t"""


def guarded_publish(spark: SparkSession, sf: str) -> DataFrame:
    """The new index only if it has open sessions and rinks; otherwise the query fails instead of replacing a good one."""
    index = feeds.index_per_rink(spark, sf)
    total = index.agg(F.sum("n_open").alias("n_all")).select(F.when(F.col("n_all") > 0, True).otherwise(F.raise_error(F.lit("nothing to publish"))).cast("boolean").alias("fit"))
    return index.crossJoin(F.broadcast(total)).where("fit").select("rink_id", "n_sessions", "n_open")


def index_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A partial run's index: refreshed rinks replace their entries, the others keep theirs."""
    rows = views.sessions(spark, sf)
    count = lambda df, run: df.groupBy("rink_id").agg(F.count("*").alias("n")).withColumn("run", F.lit(run))
    old, new = count(rows.where(F.col("start_ts") < F.expr(_NOW)), "old"), count(rows.where("rink_id % 3 = 0"), "new")
    return old.join(new.select("rink_id"), "rink_id", "left_anti").unionByName(new)


INDEX_MERGE = f"""WITH {SESSIONS} SELECT rink_id, count(*) AS n, 'new' AS run FROM sessions WHERE rink_id % 3 = 0 GROUP BY rink_id
UNION ALL SELECT rink_id, count(*), 'old' FROM sessions WHERE rink_id % 3 <> 0 AND start_ts < {_DUCK_NOW} GROUP BY rink_id"""


def three_way(spark: SparkSession, sf: str) -> DataFrame:
    """Three-way log-loss of a flat tie share around the closed-form chance, by how even the game looks."""
    rows = results._predicted(spark, sf).where("p IS NOT NULL")
    tie = F.lit(0.15)
    win, loss = F.col("p") * (F.lit(1.0) - tie), (F.lit(1.0) - F.col("p")) * (F.lit(1.0) - tie)
    chance = F.when(F.col("half") == 2, win).when(F.col("half") == 1, tie).otherwise(loss)
    bin_ = score.band(F.abs(F.col("p") - F.lit(0.5)), [0, 0.05, 0.1, 0.15, 0.2, 0.3, 9])
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), score.rounded(F.avg(-F.ln(F.greatest(F.lit(1e-9), chance)))).alias("log_loss"), F.count_if(F.col("half") == 1).alias("ties"))


THREE_WAY = f"""WITH {results._PREDICTED}
SELECT CAST(CASE WHEN abs(p - 0.5) < 0.05 THEN 0 WHEN abs(p - 0.5) < 0.1 THEN 1 WHEN abs(p - 0.5) < 0.15 THEN 2 WHEN abs(p - 0.5) < 0.2 THEN 3 WHEN abs(p - 0.5) < 0.3 THEN 4 ELSE 5 END AS BIGINT) AS bin,
  count(*) AS n, {_TIDY("avg(-ln(greatest(0.000000001, CASE half WHEN 2 THEN p * (1.0 - CAST(0.15 AS DOUBLE)) WHEN 1 THEN CAST(0.15 AS DOUBLE) ELSE (1.0 - p) * (1.0 - CAST(0.15 AS DOUBLE)) END)))")} AS log_loss,
  count(*) FILTER (WHERE half = 1) AS ties FROM predicted WHERE p IS NOT NULL GROUP BY 1"""


def signal_direction(spark: SparkSession, sf: str) -> DataFrame:
    """For each of three signals: games where it points home or away, and the home side's half points in them."""
    rows = results._predicted(spark, sf)
    signals = F.array(*[F.struct(F.lit(n).alias("signal"), c.cast("long").alias("v")) for n, c in (("number", F.col("home") - F.col("away")), ("division", F.col("division") - F.col("away") % 4), ("parity", F.col("home") % 2 - F.col("away") % 2))])
    each = rows.select("half", F.inline(signals))
    up, down = F.col("v") > 0, F.col("v") < 0
    return each.groupBy("signal").agg(F.count_if(up).alias("n_home"), F.sum(F.when(up, F.col("half")).otherwise(0)).alias("half_home"), F.count_if(down).alias("n_away"), F.sum(F.when(down, F.col("half")).otherwise(0)).alias("half_away"))


SIGNAL_DIRECTION = f"""WITH {results._PREDICTED}, s AS (
  SELECT half, 'number' AS signal, home - away AS v FROM predicted UNION ALL SELECT half, 'division', division - away % 4 FROM predicted UNION ALL SELECT half, 'parity', home % 2 - away % 2 FROM predicted)
SELECT signal, count(*) FILTER (WHERE v > 0) AS n_home, CAST(coalesce(sum(half) FILTER (WHERE v > 0), 0) AS BIGINT) AS half_home, count(*) FILTER (WHERE v < 0) AS n_away, CAST(coalesce(sum(half) FILTER (WHERE v < 0), 0) AS BIGINT) AS half_away FROM s GROUP BY signal"""


def metric_table(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the closed-form chance for all games, per part of the seasons and per division, in one grouping-sets pass."""
    rows = results._predicted(spark, sf).where("p IS NOT NULL").withColumn("part", F.when(F.col("day") < "1999-01-01", "train").otherwise("holdout"))
    y = F.col("half") / F.lit(2.0)
    hit = F.when((F.col("p") == 0.5) | (F.col("half") == 1), 0.5).when((F.col("p") > 0.5) == (F.col("half") == 2), 1.0).otherwise(0.0)
    out = rows.rollup("part", "division").agg(F.count("*").alias("n"), score.rounded(F.avg(hit)).alias("accuracy"), score.rounded(F.avg((F.col("p") - y) * (F.col("p") - y))).alias("brier"))
    return out.select(F.coalesce("part", F.lit("all")).alias("part"), F.coalesce(F.col("division").cast("string"), F.lit("all")).alias("division"), "n", "accuracy", "brier")


METRIC_TABLE = f"""WITH {results._PREDICTED}, r AS (SELECT *, CASE WHEN day < DATE '1999-01-01' THEN 'train' ELSE 'holdout' END AS part FROM predicted WHERE p IS NOT NULL)
SELECT coalesce(part, 'all') AS part, coalesce(CAST(division AS VARCHAR), 'all') AS division, count(*) AS n,
  {_TIDY("avg(CASE WHEN p = 0.5 OR half = 1 THEN 0.5 WHEN (p > 0.5) = (half = 2) THEN 1.0 ELSE 0.0 END)")} AS accuracy, {_TIDY("avg((p - half / 2.0) * (p - half / 2.0))")} AS brier
FROM r GROUP BY ROLLUP (part, division)"""


def scout_card(spark: SparkSession, sf: str) -> DataFrame:
    """For each game: the other side's record, its last three games before, and the earliest meeting of the two."""
    tg = views.team_games(views.games(spark, sf))
    rec = score.records(tg).select(F.col("team").alias("away"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("wins", "losses", "ties")]).alias("opponent_record"))
    first = tg.groupBy("team", "opp").agg(F.min_by(F.struct("day", "half_points"), F.struct("day", "game_id")).alias("m")).select(F.col("team").alias("home"), F.col("opp").alias("away"), F.col("m.day").alias("first_day"), F.col("m.half_points").alias("first_half"))
    form = asof.last_n(tg, 3).select(F.col("team").alias("away"), "day", F.col("half_last").alias("warm_up"))
    rows = views.games(spark, sf).join(rec, "away").join(first, ["home", "away"]).join(form, ["away", "day"])
    met = F.col("first_day") < F.col("day")
    return rows.select("game_id", "opponent_record", "warm_up", F.when(met, F.col("first_half")).alias("prior_half"))


SCOUT_CARD = f"""WITH {GAMES}, {TEAM_GAMES}, rec AS (SELECT team, count(*) FILTER (WHERE half_points = 2) || '-' || count(*) FILTER (WHERE half_points = 0) || '-' || count(*) FILTER (WHERE half_points = 1) AS r FROM team_games GROUP BY team),
f AS (SELECT team, opp, day, half_points FROM (SELECT *, row_number() OVER (PARTITION BY team, opp ORDER BY day, game_id) AS rn FROM team_games) WHERE rn = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY day, game_id) AS k, count(*) OVER (PARTITION BY team ORDER BY datediff('day', DATE '1970-01-01', day) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb FROM team_games),
d AS (SELECT DISTINCT team, day, nb FROM o), w AS (SELECT d.team, d.day, CAST(coalesce(sum(o.half_points), 0) AS BIGINT) AS warm FROM d LEFT JOIN o ON o.team = d.team AND o.k <= d.nb AND o.k > d.nb - 3 GROUP BY 1, 2)
SELECT g.game_id, rec.r AS opponent_record, w.warm AS warm_up, CASE WHEN f.day < g.day THEN f.half_points END AS prior_half
FROM games g JOIN rec ON rec.team = g.away JOIN f ON f.team = g.home AND f.opp = g.away JOIN w ON w.team = g.away AND w.day = g.day"""


def best_per_family(spark: SparkSession, sf: str) -> DataFrame:
    """Per family the variant with the least loss, and how much it gains on the family's first."""
    losses = score.prediction_scores(results._predicted(spark, sf), F.col("p"), F.col("half"), ["division", "home"]).select("division", F.col("home").alias("variant"), "log_loss")
    tidy = losses.select("division", "variant", score.rounded(F.col("log_loss")).alias("log_loss"))
    return tidy.groupBy("division").agg(F.min_by("variant", F.struct("log_loss", "variant")).alias("best"), F.min("log_loss").alias("log_loss"), score.rounded(F.min_by("log_loss", "variant") - F.min("log_loss")).alias("gain"))


BEST_PER_FAMILY = f"""WITH {results._PREDICTED}, l AS (SELECT division, home AS variant, {_TIDY("avg(-(half / 2.0 * ln(greatest(0.000001, least(0.999999, p))) + (1.0 - half / 2.0) * ln(1.0 - greatest(0.000001, least(0.999999, p)))))")} AS log_loss FROM predicted WHERE p IS NOT NULL GROUP BY 1, 2)
SELECT division, arg_min(variant, row(log_loss, variant)) AS best, min(log_loss) AS log_loss, {_TIDY("(arg_min(log_loss, variant) - min(log_loss))")} AS gain FROM l GROUP BY division"""

FOLDS = ((r"\bjunior\b", "jr"), (r"\bsupplier\b", "team"), (r"\bst\b", "saint"), (r"\b(?:2016|aaa|squad)\b", " "), (r"\be\b", "elite"))


def name_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier names with levels and short forms, as keys after ordered rewrites."""
    k = F.col("s_suppkey")
    name = F.concat("s_name", F.when(k % 2 == 0, " St. Junior").otherwise(" Squad AAA"), F.when(k % 3 == 0, " E").otherwise(" 2016"))
    return table(spark, sf, "supplier").select("s_suppkey", text.folded(name, FOLDS).alias("name_key"))


_FOLD_SQL = "replace(lower(s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' St. Junior' ELSE ' Squad AAA' END || CASE WHEN s_suppkey % 3 = 0 THEN ' E' ELSE ' 2016' END), '.', '')"
for _pattern, _value in FOLDS:
    _FOLD_SQL = f"regexp_replace({_FOLD_SQL}, '{_pattern}', '{_value}', 'g')"
NAME_FOLD = f"SELECT s_suppkey, trim(regexp_replace({_FOLD_SQL}, '[^a-z0-9]+', ' ', 'g')) AS name_key FROM supplier"


def narrative(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences about each team that apply, in a fixed order, joined to one text."""
    rec = score.records(views.team_games(views.games(spark, sf)))
    says = lambda test, *parts: F.when(test, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    lines = F.filter(
        F.array(
            says(F.col("wins") > F.col("losses"), "More wins than losses (", F.col("wins").cast("string"), ")."),
            says(F.col("wins") <= F.col("losses"), "No more wins than losses (", F.col("losses").cast("string"), ")."),
            says(F.col("capped_diff") > 0, "Scores more than it lets in."),
            says(F.col("ties") * 5 > F.col("games"), "Ties often."),
            says(F.col("team") % 2 == 0, "Plays in an even slot."),
        ),
        lambda x: x.isNotNull(),
    )
    return rec.select("team", F.size(lines).cast("long").alias("n_lines"), F.array_join(lines, " ").alias("blurb"))


NARRATIVE = f"""WITH rec AS ({results.RECORD}), l AS (SELECT team, list_filter([
  CASE WHEN wins > losses THEN 'More wins than losses (' || wins || ').' END, CASE WHEN wins <= losses THEN 'No more wins than losses (' || losses || ').' END,
  CASE WHEN capped_diff > 0 THEN 'Scores more than it lets in.' END, CASE WHEN ties * 5 > games THEN 'Ties often.' END, CASE WHEN team % 2 = 0 THEN 'Plays in an even slot.' END], lambda x: x IS NOT NULL) AS l FROM rec)
SELECT team, CAST(len(l) AS BIGINT) AS n_lines, array_to_string(l, ' ') AS blurb FROM l"""


def allowlist(spark: SparkSession, sf: str) -> DataFrame:
    """Games whose home side is on the list of its division, with the side's name where it is known."""
    allowed = spark.range(views.TEAMS).where("id % 5 < 2").select(F.col("id").alias("home"), (F.col("id") % 4).alias("division"))
    names = table(spark, sf, "supplier").where("s_suppkey < 12").select(F.col("s_suppkey").alias("home"), F.col("s_name").alias("name"))
    kept = views.games(spark, sf).join(allowed, ["home", "division"], "left_semi").join(names, "home", "left")
    return kept.groupBy("home").agg(F.count("*").alias("n"), F.coalesce(F.max("name"), F.lit("unverified")).alias("name"))


ALLOWLIST = f"""WITH {GAMES} SELECT home, count(*) AS n, coalesce(max(s_name), 'unverified') AS name FROM games LEFT JOIN supplier ON s_suppkey = home AND s_suppkey < 12 WHERE home % 5 < 2 GROUP BY home"""


def block_members(spark: SparkSession, sf: str) -> DataFrame:
    """For each block that has any: the events that overlap it, by start."""
    return overlap.members(*feeds._sides(spark, sf), "rink_id", "block_id", "event_id")


BLOCK_MEMBERS = f"""WITH {feeds._SIDES}
SELECT a.ingest_pos AS block_id, count(*) AS n, CAST(sum(epoch(least(a.end_ts, b.end_ts)) - epoch(greatest(a.start_ts, b.start_ts))) AS BIGINT) AS overlap_s,
       string_agg(CAST(b.ingest_pos AS VARCHAR), ',' ORDER BY b.start_ts, b.ingest_pos) AS members
FROM a JOIN b ON a.rink_id = b.rink_id AND a.start_ts < b.end_ts AND b.start_ts < a.end_ts GROUP BY 1"""

QUERIES = {
    "feed_games": feed_games, "freshness": freshness, "slice_with_fallback": slice_with_fallback, "alias_resolve": alias_resolve, "cross_season": cross_season, "standings": standings,
    "score_parse": score_parse, "labels": labels, "calendar_link": calendar_link, "guarded_publish": guarded_publish, "index_merge": index_merge, "three_way": three_way,
    "name_fold": name_fold, "narrative": narrative, "allowlist": allowlist, "block_members": block_members,
    "signal_direction": signal_direction, "metric_table": metric_table, "scout_card": scout_card, "best_per_family": best_per_family,
}
SQL = {
    "feed_games": FEED_GAMES, "freshness": FRESHNESS, "slice_with_fallback": SLICE_WITH_FALLBACK, "alias_resolve": ALIAS_RESOLVE, "cross_season": CROSS_SEASON, "standings": STANDINGS,
    "score_parse": SCORE_PARSE, "labels": LABELS, "calendar_link": CALENDAR_LINK, "index_merge": INDEX_MERGE, "three_way": THREE_WAY,
    "name_fold": NAME_FOLD, "narrative": NARRATIVE, "allowlist": ALLOWLIST, "block_members": BLOCK_MEMBERS,
    "signal_direction": SIGNAL_DIRECTION, "metric_table": METRIC_TABLE, "scout_card": SCOUT_CARD, "best_per_family": BEST_PER_FAMILY,
    "guarded_publish": f"WITH idx AS ({feeds.INDEX_PER_RINK}) SELECT rink_id, n_sessions, n_open FROM idx",
}
