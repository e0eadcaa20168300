"""Evaluation of model answers: a stratified sample, typed validation of JSON answers, and metrics over all records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwright.functions.session import cut_off
from postwright.functions.text import alias_key
from postwright.operators.guards import CAREER_WORDS, INJECTION, MIN_CONFIDENCE, canonical_mode, token_cost
from postwright.operators.questions import BROADCAST_ALIASES

# Seed and shares of the sample, and words of technical titles.
SEED = 20260724
TRUNCATED_SHARE = 0.70
DIAGNOSTIC = 15
LONG_TEXT = 1500
TECHNICAL = [
    "developer", "engineer", "software", "data", "devops", "cloud", "security", "backend", "frontend", "full stack", "machine learning", "ai", "ml", "python",
    "java", "platform", "sre", "architect", "qa", "analyst",
]
# Fixed value: postings that costs are carried on to.
CORPUS = 35968
#: Pieces that the values of a group are parted into to find a rank.
PIECES = 64


def sample(jobs: DataFrame, size: int, seed: int = SEED, truncated: str = "adzuna", technical: str = "remoteok", share: float = TRUNCATED_SHARE, diagnostic: int = DIAGNOSTIC, long_text: int = LONG_TEXT) -> DataFrame:
    """``(job_id, stratum, diagnostic_group)``: ``size`` jobs in strata with quotas; what one lacks goes to the next.

    1. jobs of the ``truncated`` source in the Netherlands and Italy, ``diagnostic`` at most;
    2. its other jobs, and 3. any of its jobs, up to ``share`` of the sample; 4. jobs with long texts, and technical titles
    of the ``technical`` source; 5. any job, as long as some are missing. Within a stratum jobs come in order of a hash of seed and id.
    ``jobs``: job_id (unique), source, country, title, n_chars.

    One pass ranks all strata at once and keeps twice the sample's size of each, which
    suffices as no more than ``size`` of a stratum can be taken before it; a limit by group leaves that many
    rows a task. The quotas are then settled by windows over these few rows, in one job.
    """
    target = round(size * share)
    own = F.coalesce(F.col("source") == truncated, F.lit(False))
    special = F.coalesce(F.lower("country").isin("nl", "it"), F.lit(False))
    title = alias_key(F.coalesce("title", F.lit("")))
    full = F.coalesce((F.col("n_chars") >= long_text) | (F.col("source") == technical) & reduce(lambda a, b: a | b, [title.contains(w) for w in TECHNICAL]), F.lit(False))
    strata = [("1", 1, own & special), ("2", 2, own & ~special), ("3", 5, own), ("4", 3, full), ("5", 4, F.lit(True))]
    key = lambda offset: F.sha2(F.concat(F.lit(f"{seed + offset}:"), F.col("job_id").cast("string")).cast("binary"), 256)
    rows = jobs.select("job_id", F.explode(F.filter(F.array(*[F.when(c, F.struct(F.lit(s).alias("s"), key(k).alias("key"))) for s, k, c in strata]), lambda x: x.isNotNull())).alias("x"))
    ranked = rows.select("job_id", "x.*").withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("key", "job_id"))).where(F.col("r") <= 2 * size)
    few = ranked.groupBy("job_id").agg(*[F.max(F.when(F.col("s") == s, F.col("r"))).alias(f"r{s}") for s, _, _ in strata])
    everyone, taken, stratum = Window.partitionBy(F.lit(0)), F.lit(0), F.lit(None).cast("string")
    quotas = {"1": min(diagnostic, target), "2": target, "3": target, "4": size - target, "5": size}
    before = F.lit(0)
    for s, _, _ in strata:
        quota = F.lit(quotas[s]) - (taken if s in "23" else before if s == "5" else F.lit(0))
        free = F.col(f"r{s}").isNotNull() & F.col("stratum").isNull() if s != "1" else F.col("r1").isNotNull()
        few = few.withColumn("stratum", stratum) if s == "1" else few
        nth = F.row_number().over(everyone.orderBy(F.when(free, F.col(f"r{s}")).asc_nulls_last(), "job_id"))
        few = few.withColumn("stratum", F.when(free & (nth <= F.greatest(quota, F.lit(0))), s).otherwise(F.col("stratum")))
        few = few.withColumn(f"n{s}", F.count_if(F.col("stratum") == s).over(everyone))
        before = before + F.col(f"n{s}")
        if s in "123":
            taken = taken + F.col(f"n{s}")
    name = F.when(F.col("stratum").isin("1", "2", "3"), "truncated").when(F.col("stratum") == "4", "full_text").otherwise("fallback")
    return few.where("stratum is not null").select("job_id", name.alias("stratum"), F.when(F.col("stratum") == "1", "nl_it_diagnostic").otherwise("standard").alias("diagnostic_group"))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _confidence(v: Column) -> Column:
    """Null counts as 0; what is no number is null here."""
    c = _get(v, "$.confidence", "variant")
    return F.when(c.isNull() | F.is_variant_null(c), 0.0).otherwise(_get(v, "$.confidence", "double"))


def _text(v: Column, name: str) -> Column:
    return F.when(F.schema_of_variant(_get(v, f"$.{name}", "variant")) == "STRING", _get(v, f"$.{name}", "string"))


def _years(v: Column, name: str) -> Column:
    return _get(v, f"$.{name}", "double")


def _bad_years(v: Column, name: str) -> Column:
    """Neither absent, nor a word for unknown, nor a number."""
    raw = _get(v, f"$.{name}", "variant")
    unknown = alias_key(F.coalesce(_text(v, name), F.lit("x"))).isin("", "unknown", "not specified", "n/a")
    return raw.isNotNull() & ~F.is_variant_null(raw) & ~unknown & _years(v, name).isNull()


def _career(x: Column) -> Column:
    of = {word: level for level, words in CAREER_WORDS.items() for word in words}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in of.items() for v in kv]), alias_key(F.coalesce(x, F.lit("")))), F.lit("unknown"))


def _injected(x: Column) -> Column:
    return alias_key(F.coalesce(x, F.lit(""))).rlike("|".join(INJECTION))


def validated(answers: DataFrame, jobs: DataFrame, index: DataFrame) -> DataFrame:
    """``(job_id, field, value, canonical, verdict, reason)`` of everything that JSON answers claim.

    ``answers``: job_id, answer, error (of the call, or null). ``jobs``: job_id, text, skills
    (found already), career_level ("unknown" if none), experience_min_years, remote_mode, is_remote. ``index`` is an alias index.
    Answers are read as VARIANT, so a value of a wrong type spoils an answer and isn't coerced away: it has one
    row for the call, the JSON or an injection. Else skills, career_level, experience and work_mode have a
    row each: ``accepted``, ``unmapped`` (a skill that the ontology doesn't know), ``conflict`` (with what was
    computed from the posting or its metadata) or ``rejected``, the first reason that applies. Unknown levels, modes and
    years without figures claim nothing. Answers to jobs that aren't there are left out; a null answer isn't JSON.
    Claims go without their text, and the index to the tasks behind a count: few names don't gather the claims in a few tasks.
    """
    own = jobs.select("job_id", F.coalesce("text", F.lit("")).alias("text"), "skills", F.col("career_level").alias("own_level"), F.col("experience_min_years").alias("own_years"), F.col("remote_mode").alias("own_mode"), "is_remote")
    # a row number stays in the plan to the end, so that no filter is pushed below the parsing and repeats it
    d = answers.select("job_id", "answer", "error").join(own, "job_id").withColumns({"v": F.try_parse_json("answer"), "row": F.monotonically_increasing_id()})
    sub = lambda name: _get(F.col("v"), f"$.{name}", "variant")
    claims = _get(F.col("v"), "$.skills", "array<variant>")
    ok = lambda c: F.coalesce(c.between(0, 1), F.lit(False))
    part = lambda p: _get(p, "$", "map<string,variant>").isNotNull()
    whole = lambda p: p.isNull() | part(p) & ok(_confidence(p))
    good_skill = lambda x: part(x) & _text(x, "name").isNotNull() & _text(x, "evidence").isNotNull() & ok(_confidence(x)) & (
        F.size(F.array_except(F.map_keys(_get(x, "$", "map<string,variant>")), F.array(*[F.lit(k) for k in ("name", "evidence", "confidence", "explicit")]))) == 0
    )
    e = sub("experience_requirement")
    valid = part(F.col("v")) & (sub("skills").isNull() | claims.isNotNull() & F.forall(F.coalesce(claims, F.expr("cast(array() as array<variant>)")), lambda x: F.coalesce(good_skill(x), F.lit(False))))
    valid = valid & whole(sub("career_level")) & whole(e) & whole(sub("work_mode")) & (e.isNull() | ~_bad_years(e, "minimum_years") & ~_bad_years(e, "maximum_years"))
    one = lambda field, value, reason, flaw=None: F.struct(F.lit(field).alias("field"), value.alias("value"), (F.lit(None) if flaw is None else flaw).cast("string").alias("flaw"), reason.cast("string").alias("reason"))
    parts = {"career": sub("career_level"), "exp": e, "mode": sub("work_mode")}
    d = d.select(
        "*", F.coalesce(valid, F.lit(False)).alias("valid"), _injected(F.col("answer")).alias("injected"), claims.alias("claims"),
        *[_text(v, "evidence").alias(f"{p}_evidence") for p, v in parts.items()], *[_confidence(v).alias(f"{p}_confidence") for p, v in parts.items()],
        _years(e, "minimum_years").alias("low"), _years(e, "maximum_years").alias("high"), _career(_get(parts["career"], "$.value", "string")).alias("level"), canonical_mode(_get(parts["mode"], "$.value", "string")).alias("kind"),
    )
    # evidence is judged where the text is, as claims leave it behind
    flaw = lambda e, c: F.when((e == "") | ~F.col("text").contains(e), "hallucinated_evidence").when(c < MIN_CONFIDENCE, "low_confidence")
    skills = F.transform(F.coalesce("claims", F.expr("cast(array() as array<variant>)")), lambda s: one("skill", _text(s, "name"), F.when(_injected(_text(s, "evidence")), "prompt_injection"), flaw(_text(s, "evidence"), _confidence(s))))
    fields = F.filter(F.array(*[F.when(value.isNotNull(), one(name, value, reason)) for name, value, reason in _fields()]), lambda c: c.isNotNull())
    items = (
        F.when(F.col("error").isNotNull(), F.array(one("call", F.lit(""), F.col("error"))))
        .when(~F.col("valid"), F.array(one("json", F.lit(""), F.lit("invalid_json_schema"))))
        .when(F.col("injected"), F.array(one("response", F.lit(""), F.lit("prompt_injection"))))
        .otherwise(F.concat(skills, fields))
    )
    s = d.select("row", "job_id", "skills", F.posexplode(items).alias("pos", "i")).select("row", "job_id", "skills", "pos", "i.*")
    names = index.groupBy("folded").agg(F.min_by("canonical", F.struct("alias_ord", "canonical")).alias("canonical"))
    names = F.broadcast(names) if index.count() <= BROADCAST_ALIASES else names
    s = s.withColumn("folded", F.when(F.col("field") == "skill", alias_key(F.col("value")))).join(names, "folded", "left")
    known = F.coalesce(F.array_contains("skills", F.col("canonical")), F.lit(False))
    skill_reason = F.when(F.col("canonical").isNull(), "unknown_ontology_skill").otherwise(F.coalesce("flaw", F.when(known, "already_deterministic"), "reason"))
    s = s.withColumn("reason", F.when(F.col("field") == "skill", skill_reason).otherwise(F.col("reason")))
    first = F.min(F.when(F.col("reason").isNull(), F.col("pos"))).over(Window.partitionBy("row", "canonical"))
    s = s.withColumn("reason", F.when((F.col("field") == "skill") & F.col("reason").isNull() & (first < F.col("pos")), "duplicate_skill").otherwise(F.col("reason")))
    verdict = (
        F.when((F.col("field") == "skill") & F.col("canonical").isNull(), "unmapped").when(F.col("reason").isNull(), "accepted")
        .when(F.col("field").isin("career_level", "experience", "work_mode") & F.col("reason").endswith("_conflict"), "conflict").otherwise("rejected")
    )
    canonical = F.when(F.col("field") == "skill", F.col("canonical")).when(F.col("reason").isNull(), F.col("value"))
    return s.select("job_id", "field", "value", canonical.alias("canonical"), verdict.alias("verdict"), "reason")


def _fields() -> list[tuple[str, Column, Column]]:
    """Name, value and reason against it, of career level, experience and work mode."""

    def grounded(p: str) -> Column:
        evidence = F.col(f"{p}_evidence")
        return F.when(F.col(f"{p}_confidence") < MIN_CONFIDENCE, "low_confidence").when((F.coalesce(evidence, F.lit("")) == "") | ~F.col("text").contains(evidence), "hallucinated_evidence").when(_injected(evidence), "prompt_injection")

    low, high, level, kind = (F.col(c) for c in ("low", "high", "level", "kind"))
    said = F.when(F.col("is_remote"), "remote").when(~F.col("is_remote"), "on_site")
    conflict = lambda c: F.when(c, "deterministic_conflict")
    years = F.coalesce(grounded("exp"), conflict(F.col("own_years").isNotNull() & ~F.col("own_years").eqNullSafe(low)))
    return [
        ("career_level", F.when(level != "unknown", level), F.coalesce(grounded("career"), conflict((F.col("own_level") != "unknown") & (F.col("own_level") != level)))),
        ("experience", F.when(low.isNotNull() | high.isNotNull(), F.coalesce(low.cast("string"), F.lit(""))), F.when(high < low, "contradictory_experience").when(low < 0, "invalid_experience").otherwise(years)),
        ("work_mode", F.when(kind != "unknown", kind), F.coalesce(grounded("mode"), F.when(said != kind, "metadata_conflict"), conflict(F.col("own_mode") != kind))),
    ]


def order_statistics(values: DataFrame, column: str, by: list[str], ranks: dict[str, Column]) -> DataFrame:
    """``(*by, name, value)``: the values at some ranks (from 0) of each group in order; nulls don't count.

    ``ranks`` gives each rank as an expression of ``total``, the size of the group. Values are counted
    first. Each group's distinct values are parted into ``PIECES`` by approximate quantiles; how many rows
    lie before a piece follows from counts alone, and only the pieces with a wanted rank are ordered, each by
    itself: no task orders a group. The result is exact, whatever the quantiles, as long as the counts before a piece
    and the piece itself go by the same ones: they depend on the order in which tasks' sketches meet, so they are kept.
    """
    keys = [F.struct(F.lit(1).alias("one"), *by).alias("g")]
    hist = cut_off(values.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("v")).groupBy("g", "v").agg(F.count("*").alias("n")))
    cuts = cut_off(hist.groupBy("g").agg(F.percentile_approx("v", [k / PIECES for k in range(1, PIECES)], 1000).alias("cuts"), F.sum("n").alias("total")))
    parted = hist.join(cuts.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")))
    parted = parted.select("g", "v", "n", "total", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("piece"))
    pieces = parted.groupBy("g", "piece").agg(F.sum("n").alias("n"), F.first("total").alias("total"))
    earlier = Window.partitionBy("g").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    want = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])
    wanted = pieces.select(F.col("g").alias("h"), F.col("piece").alias("p"), "before", F.col("n").alias("inside"), F.explode(want).alias("w")).where((F.col("w.rank") >= F.col("before")) & (F.col("w.rank") < F.col("before") + F.col("inside")))
    near = parted.join(wanted, F.col("g").eqNullSafe(F.col("h")) & (F.col("piece") == F.col("p")))
    upto = F.sum("n").over(Window.partitionBy("g", "piece", "w.name").orderBy("v")) + F.col("before")
    found = near.withColumn("upto", upto).where(F.col("upto") > F.col("w.rank")).groupBy("g", F.col("w.name").alias("name")).agg(F.min("v").alias("value"))
    return found.select(*[F.col(f"g.{b}").alias(b) for b in by], "name", "value")


def nearest(p: float) -> Column:
    """The nearest rank of a share; halves go to the even one."""
    return F.least(F.col("total") - 1, F.bround((F.col("total") - 1) * p))


def metrics(records: DataFrame, items: DataFrame) -> DataFrame:
    """``(stratum, metric, value)`` over all records (stratum null) and over each stratum.

    ``records``: job_id (unique), stratum, skill_count, error, prompt_tokens, completion_tokens, latency_ms, and the
    computed career_level, experience_min_years, remote_mode; ``items``: rows of ``validated``. Rates of nothing are 0.
    A metric ``rejected:<reason>`` counts what was not accepted for that reason. Each record's items are
    counted once; both levels of grouping come from one aggregation over the records.
    """
    is_ = lambda v: F.col("verdict") == v
    skill = F.col("field") == "skill"
    value = lambda f: F.max(F.when((F.col("field") == f) & is_("accepted"), F.col("value")))
    own = items.groupBy("job_id").agg(
        F.count_if(skill & is_("accepted")).alias("accepted"), F.count_if(is_("unmapped")).alias("unmapped"), F.count_if(is_("rejected") | is_("conflict")).alias("rejected"),
        F.bool_or(F.col("field").isin("call", "json")).alias("invalid"), value("career_level").alias("career"), value("experience").alias("years"), value("work_mode").alias("mode"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    named = "job_id stratum skill_count error prompt_tokens completion_tokens latency_ms career_level experience_min_years remote_mode".split()
    r = records.select(*named).join(own, "job_id", "left").withColumns({c: zero(F.col(c)) for c in ("accepted", "unmapped", "rejected")})
    agree = lambda claim, computed: F.count_if(claim.isNull() | F.coalesce(claim == computed, F.lit(False))) / F.count("*")
    rate = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    acc, rej, unm = F.sum("accepted"), F.sum("rejected"), F.sum("unmapped")
    prompt, completion = zero(F.sum("prompt_tokens")), zero(F.sum("completion_tokens"))
    cost = token_cost(prompt, completion)
    figures = {
        "jobs": F.count("*"), "calls": F.count_if((zero(F.col("prompt_tokens")) != 0) | (zero(F.col("completion_tokens")) != 0) | (zero(F.col("latency_ms")) > 0)),
        "successful": F.count_if(F.col("error").isNull()), "failed": F.count_if(F.col("error").isNotNull()),
        "valid_json_rate": F.count_if(~F.coalesce("invalid", F.lit(False))) / F.count("*"), "acceptance_rate": rate(acc, acc + rej + unm), "rejection_rate": rate(rej + unm, acc + rej + unm),
        "accepted": acc, "rejected_or_unmapped": rej + unm, "unmapped": unm, "mean_accepted": F.avg("accepted"), "jobs_with_additions": F.count_if(F.col("accepted") > 0),
        "matcher_mean_skills": F.avg("skill_count"), "combined_mean_skills": F.avg(F.col("skill_count") + F.col("accepted")),
        "accepted_zero_skill": zero(F.sum(F.when(F.col("skill_count") == 0, F.col("accepted")))), "accepted_nonzero_skill": zero(F.sum(F.when(F.col("skill_count") > 0, F.col("accepted")))),
        "jobs_zero_skill_accepted": F.count_if((F.col("skill_count") == 0) & (F.col("accepted") > 0)), "jobs_nonzero_skill_accepted": F.count_if((F.col("skill_count") > 0) & (F.col("accepted") > 0)),
        "career_agreement": agree(F.col("career"), F.col("career_level")), "experience_agreement": agree(F.col("years").try_cast("double"), F.col("experience_min_years")), "mode_agreement": agree(F.col("mode"), F.col("remote_mode")),
        "new_levels": F.count_if((F.col("career_level") == "unknown") & F.col("career").isNotNull()), "mean_latency_ms": F.coalesce(F.avg("latency_ms"), F.lit(0.0)),
        "prompt_tokens": prompt, "completion_tokens": completion, "cost_usd": cost, "cost_usd_1000": cost / F.count("*") * 1000, "cost_usd_corpus": cost / F.count("*") * CORPUS,
    }
    wide = r.groupingSets([["stratum"], []], "stratum").agg(*[f.cast("double").alias(n) for n, f in figures.items()])
    long = wide.select("stratum", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in figures])).alias("m")).select("stratum", "m.*")
    both = lambda d: d.withColumn("stratum", F.explode(F.array(F.col("stratum"), F.lit(None).cast("string"))))
    latency = order_statistics(both(r.select("stratum", "latency_ms")), "latency_ms", ["stratum"], {"p50_latency_ms": nearest(0.50), "p95_latency_ms": nearest(0.95)})
    half = (F.col("total") - 1) / 2
    median = order_statistics(both(r.select("stratum", "accepted")), "accepted", ["stratum"], {"low": F.floor(half), "high": F.ceil(half)})
    median = median.groupBy("stratum").agg(F.avg("value").alias("value")).select("stratum", F.lit("median_accepted").alias("metric"), "value")
    lost = items.where("reason is not null").join(records.select("job_id", "stratum"), "job_id")
    reasons = lost.groupingSets([["stratum", "reason"], ["reason"]], "stratum", "reason").agg(F.count("*").cast("double").alias("value")).select("stratum", F.concat(F.lit("rejected:"), "reason").alias("metric"), "value")
    return long.unionByName(latency.select("stratum", F.col("name").alias("metric"), F.col("value").cast("double").alias("value"))).unionByName(median).unionByName(reasons)
