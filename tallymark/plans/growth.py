"""Growth standards and the student-level growth table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bands import SCORE_EDGES, SCORE_LABELS, grade_band, score_band
from ..functions.flags import at_least
from ..functions.missing import name, nan_to_null
from ..operators.joins import keyed_join
from ..operators.quantiles import exact_quantiles, percentile_quantiles
from ..operators.records import extreme
from ..operators.settle import settle

# The quantiles of growth reported per band.
STANDARD_PROBS = {"median_score": 0.5, "score_60": 0.6, "score_70": 0.7}
SCORE_BANDS = (SCORE_EDGES, SCORE_LABELS)
# Fixed value: two-year growth under the standard used before.
PREVIOUS_TWO_YEAR_STANDARD = 1.4


def scores_by_year(
    df: DataFrame,
    years: list[int],
    id: str = "id",
    year: str = "year",
    score: str = "score",
    grade: str | None = None,
    all_missing: str = "inf",
) -> DataFrame:
    """One row per student: highest score (and lowest grade) of each year.

    Gives ``score_<year>``, ``grade_<year>`` and ``n_<year>``, the number of
    records. One shuffle, by student. A year without records is null; a year
    with records but no score follows ``all_missing``.
    """
    aggregates = []
    for y in years:
        here = name(year) == y
        n = F.count_if(here)
        aggregates.append(n.alias(f"n_{y}"))
        score_of = extreme(F.max(F.when(here, name(score))), "max", all_missing)
        aggregates.append(F.when(n > 0, score_of).alias(f"score_{y}"))
        if grade is not None:
            grade_of = extreme(F.min(F.when(here, name(grade))), "min", all_missing)
            aggregates.append(F.when(n > 0, grade_of).alias(f"grade_{y}"))
    return df.where(name(year).isin(years)).groupBy(name(id)).agg(*aggregates)


def growth_pairs(
    scores: DataFrame, current: int, prior: int, same_grade: bool = True, bands=SCORE_BANDS, grade_bands: bool = False
) -> DataFrame:
    """Prior band and growth per student with a prior-year record.

    ``bands`` are (edges, labels). ``grade_bands`` adds the band of the prior grade.

    With ``same_grade`` a student whose grade changed has no growth (but still
    counts), because the published standards pair the years by student and
    grade; without it the years are paired by student alone.
    """
    now, before = F.col(f"score_{current}"), F.col(f"score_{prior}")
    if same_grade:
        now = F.when(F.col(f"grade_{current}").eqNullSafe(F.col(f"grade_{prior}")), now)
    by_grade = [grade_band(F.col(f"grade_{prior}")).alias("grade_band")] if grade_bands else []
    return scores.where(F.col(f"n_{prior}") > 0).select(
        *by_grade, score_band(before, *bands).alias("score_band"), nan_to_null(now - before).alias("growth")
    )


def growth_standards(
    scores: DataFrame,
    current: int,
    prior: int,
    same_grade: bool = True,
    probs: dict[str, float] = STANDARD_PROBS,
    method: str = "slices",
    bands=SCORE_BANDS,
    grade_bands: bool = False,
) -> DataFrame:
    """Quantiles of growth, and the number of students, per prior-score band
    (and grade band, with ``grade_bands``).

    ``scores`` comes from ``scores_by_year``. ``method="slices"`` holds for any
    scores; ``"percentile"`` is one aggregation for scores on a grid.
    """
    quantiles = {"slices": exact_quantiles, "percentile": percentile_quantiles}[method]
    pairs = growth_pairs(scores, current, prior, same_grade, bands, grade_bands)
    keys = ["grade_band", "score_band"] if grade_bands else ["score_band"]
    return quantiles(pairs.where(F.col("score_band").isNotNull()), keys, "growth", probs)


def with_standard(
    df: DataFrame, standards: DataFrame, score: str, out: str, quantile: str = "score_60", bands=SCORE_BANDS,
    grade: str | None = None,
) -> DataFrame:
    """Attach the standard of the band that ``score`` is in.

    Standards by grade band too need ``grade``, the column of the grade. The
    standards, one per band, are made once into a map from band to standard, a
    single value that every task looks up in: no row is joined or moved. The
    job fails if a band occurs twice.
    """
    by_grade = "grade_band" in standards.columns
    if by_grade and grade is None:
        raise ValueError("these standards are by grade band: name the grade's column")

    def key_of(band: Column, grade: Column) -> Column:
        return F.struct(grade.alias("grade"), band.alias("band")) if by_grade else band

    entry = F.struct(key_of(F.col("score_band"), F.col("grade_band")), name(quantile))
    listed = standards.where(F.col("score_band").isNotNull()).agg(F.map_from_entries(F.collect_list(entry)))
    here = key_of(score_band(name(score), *bands), grade_band(name(grade)) if by_grade else F.lit(None))
    return df.withColumn(out, F.try_element_at(listed.scalar(), here))


def attach_standard(
    scores: DataFrame, standards: DataFrame, years: list[int], id: str = "id", quantile: str = "score_60",
    bands=SCORE_BANDS,
) -> DataFrame:
    """Per student-year: the highest score and the standard for growth from it.

    ``scores`` comes from ``scores_by_year`` of the same years.
    """
    by_grade = "grade_band" in standards.columns
    yearly = F.array(*[
        F.struct(
            F.lit(y).alias("year"), F.col(f"n_{y}").alias("n"), F.col(f"score_{y}").alias("score"),
            (F.col(f"grade_{y}") if by_grade else F.lit(None)).alias("_grade"),
        )
        for y in years
    ])
    long = scores.select(name(id), F.explode(yearly).alias("y")).where("y.n > 0").select(
        "y.year", name(id), "y.score", "y._grade"
    )
    attached = with_standard(long, standards, "score", "growth_standard", quantile, bands, "_grade" if by_grade else None)
    return attached.drop("_grade")


def student_growth(
    scores: DataFrame,
    standards: DataFrame,
    current: int,
    id: str = "id",
    quantile: str = "score_60",
    compare_decimals: int | None = None,
    bands=SCORE_BANDS,
) -> DataFrame:
    """Scores of three years side by side, growth, and whether it met standard.

    One row per student with a current-year record, from ``scores_by_year``.
    Growth over one year is measured against the prior year's standard, over
    two years against the sum of both earlier standards. The numerator is met
    over one or two years, the denominator is a known one-year result.
    """
    years = {"current": current, "prior": current - 1, "two_back": current - 2}
    by_grade = "grade_band" in standards.columns
    wide = scores.where(F.col(f"n_{current}") > 0).select(
        name(id), *[F.col(f"score_{y}").alias(f"score_{when}") for when, y in years.items()],
        *[F.col(f"grade_{y}").alias(f"_grade_{when}") for when, y in years.items() if by_grade],
    )
    for when in years:
        grade = f"_grade_{when}" if by_grade else None
        wide = with_standard(wide, standards, f"score_{when}", f"standard_{when}", quantile, bands, grade)
    wide = wide.drop(*[f"_grade_{when}" for when in years])
    grown = wide.withColumns({
        "growth_1yr": nan_to_null(F.col("score_current") - F.col("score_prior")),
        "growth_2yr": nan_to_null(F.col("score_current") - F.col("score_two_back")),
        "growth_standard_1yr": F.col("standard_prior"),
        "growth_standard_2yr": F.col("standard_two_back") + F.col("standard_prior"),
    })
    met = grown.withColumns({
        "met_growth_1yr": at_least(F.col("growth_1yr"), F.col("growth_standard_1yr"), compare_decimals),
        "met_growth_2yr": at_least(F.col("growth_2yr"), F.col("growth_standard_2yr"), compare_decimals),
        "met_growth_2yr_prev_standard": at_least(
            F.col("growth_2yr"), F.lit(PREVIOUS_TWO_YEAR_STANDARD), compare_decimals
        ),
    })
    return met.withColumns({
        "numerator": F.col("met_growth_1yr") | F.col("met_growth_2yr"),
        "denominator": F.col("met_growth_1yr").isNotNull(),
    })


def indicator_growth(
    records: DataFrame,
    current: int,
    same_grade: bool = True,
    all_missing: str = "inf",
    compare_decimals: int | None = None,
    bands=SCORE_BANDS,
    grade_bands: bool = False,
    **columns,
) -> DataFrame:
    """``student_growth`` from test records of three years, standards included.

    Building the result runs jobs: the yearly scores and the standards are written.
    The records are read and shuffled once: the yearly scores, from which both
    the standards and the growth come, are written in between, in buckets by
    student, so that what is joined to the growth by student finds it in place.
    """
    years = [current, current - 1, current - 2]
    columns = {"grade": "grade" if same_grade or grade_bands else None, **columns}
    scores = settle(scores_by_year(records, years, all_missing=all_missing, **columns), by=[columns.get("id", "id")])
    found = growth_standards(scores, current, current - 1, same_grade, bands=bands, grade_bands=grade_bands)
    return student_growth(
        scores, found, current, columns.get("id", "id"), compare_decimals=compare_decimals, bands=bands
    )


def student_table(
    growth: DataFrame,
    enrolment: DataFrame,
    demographics: DataFrame,
    id: str = "id",
    demographic_keys: list[str] | None = None,
    null_keys: str = "match",
    hot: bool = False,
) -> DataFrame:
    """Attach school and demographics to each student's growth.

    Neither table need be unique by student: a student with two records is
    counted twice. Instead of repeating rows, equal ones are one row with
    ``copies``, so that no student's records are multiplied out; weigh by
    ``copies`` to count. ``demographic_keys`` joins on more than the student.
    ``null_keys="never"`` leaves students without id undescribed and unenrolled,
    where the default joins them with every row that has none.

    Each table is shuffled by student once, the growth not at all where it is stored
    by student (``indicator_growth``). Rows without id never take part in that: if
    the growth has any (a job asks), their distinct descriptions and enrolments,
    summed before they are shuffled, are joined apart. ``hot`` is for tables in which one
    student has a large share of the rows: all are summed before they are shuffled, and
    students with many enrolments are spread over tasks, for a shuffle more of each
    and a job that counts.
    """
    keys = demographic_keys or [id]
    there = name(id).isNotNull()
    described, enrolled = demographics.where(there), enrolment.where(there)
    if not hot:
        described, enrolled = described.repartition(name(id)), enrolled.repartition(name(id))
    described, enrolled = _counted(described, "_described"), _counted(enrolled, "_enrolled")
    people = keyed_join(growth, described, keys, null_keys="never" if keys == [id] else null_keys)
    joined = keyed_join(people, settle(enrolled) if hot else enrolled, [id], null_keys="never", hot="right" if hot else None)
    if null_keys == "match" and not growth.where(~there).isEmpty():
        lone = keyed_join(growth.where(~there), _counted(demographics.where(~there), "_described"), keys)
        lone = keyed_join(lone, _counted(enrolment.where(~there), "_enrolled"), [id])
        joined = joined.where(there).unionByName(lone)
    one = F.lit(1).cast("bigint")
    copies = F.coalesce("_enrolled", one) * F.coalesce("_described", one)
    return joined.withColumn("copies", copies).drop("_enrolled", "_described")


def _counted(df: DataFrame, out: str) -> DataFrame:
    """Distinct rows with their number."""
    return df.groupBy(*map(name, df.columns)).agg(F.count("*").alias(out))
