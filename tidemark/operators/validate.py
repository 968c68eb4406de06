"""Named quality rules over standardized records.

Rules are grouped into checks. Inside a check the first rule that holds wins; all checks run on
every record. Each check becomes one column holding the name of the failed rule or NULL, so that
counting, splitting and scoring records never needs the failure array: it is only built when
something downstream reads it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions import geo, numbers, text, times

REJECT, FLAG, OBSERVE = "reject", "flag", "observe"


@dataclass(frozen=True)
class Rule:
    """``detail`` may use ``{name}`` parts, filled from ``parts``."""

    name: str
    severity: str
    detail: str
    when: Column
    value: Column | None = None
    parts: dict[str, Column] | None = None

    @property
    def detail_column(self) -> Column:
        pieces = [p for p in re.split(r"(\{\w+\})", self.detail) if p]
        columns = [
            F.coalesce(self.parts[p[1:-1]].cast("string"), F.lit("None"))
            if p.startswith("{")
            else F.lit(p)
            for p in pieces
        ]
        return F.concat(*columns)


def builtin_checks(as_of: Column | None, columns: list[str]) -> dict[str, list[Rule]]:
    """The 16 registered rules. Without ``as_of`` the future-date rule has no opinion; without a
    ``found_borough`` column the polygon rule is not checked."""
    c = F.col
    known = {name: (severity, detail) for name, severity, detail in fixed.RULES}

    def rule(name: str, when: Column, value: Column | None = None, **parts: Column) -> Rule:
        severity, detail = known[name]
        return Rule(name, severity, detail, when, value, parts)

    created, closed = c("created_date"), c("closed_date")
    zip5, zip_raw, borough = c("incident_zip"), c("incident_zip_raw"), c("borough")
    lat, lon = c("latitude"), c("longitude")
    lat_text, lon_text = numbers.number_text(lat), numbers.number_text(lon)
    point_text = F.concat(lat_text, F.lit(","), lon_text)
    zip_borough = c("zip_borough")
    slash = F.lit("/")

    place = [
        rule(
            "borough_zip_conflict",
            ~geo.zip_matches_borough(zip5, zip_borough, borough),
            F.concat(borough, slash, zip5),
            borough=borough,
            zip=zip5,
            expected=zip_borough,
        )
    ]
    if "found_borough" in columns:
        found = c("found_borough")
        place.append(
            rule(
                "borough_geo_conflict",
                geo.in_city_box(lat, lon) & (found != borough),
                F.concat(borough, slash, point_text),
                borough=borough,
                found=found,
            )
        )
    checks = {
        "key": [rule("unique_key_missing", text.is_blank(c("unique_key")))],
        "category": [
            rule("complaint_type_missing", text.is_blank(c("complaint_type_raw"))),
            rule(
                "complaint_type_unrecognized",
                ~c("known_category"),
                c("complaint_type_raw"),
            ),
        ],
        "dates": [
            rule("created_date_missing", created.isNull()),
            rule(
                "closed_before_created",
                closed < created - F.expr(fixed.CLOSE_SKEW),
                times.iso_text(closed),
                delta=times.duration_text(times.micros_between(created, closed)),
            ),
        ],
        "zip": [
            rule("zip_missing", zip5.isNull() & text.is_blank(zip_raw)),
            rule("zip_malformed", zip5.isNull(), zip_raw),
            rule("zip_outside_nyc", ~geo.zip_in_city(zip5, zip_borough), zip5),
        ],
        "point": [
            rule("coords_missing", lat.isNull() & lon.isNull()),
            rule(
                "coords_partial",
                lat.isNull() | lon.isNull(),
                F.concat(F.lit("lat="), lat_text, F.lit(" lon="), lon_text),
            ),
            rule("coords_null_island", geo.is_zero_point(lat, lon), F.lit("0,0")),
            rule("coords_swapped", geo.looks_swapped(lat, lon), point_text),
            rule("coords_outside_nyc", ~geo.in_city_box(lat, lon), point_text),
        ],
        "place": place,
    }
    if as_of is not None:
        checks["future"] = [
            rule(
                "created_date_future",
                created > as_of + F.expr(fixed.FUTURE_SLACK),
                times.iso_text(created),
            )
        ]
    return checks


def _cases(rules: list[Rule], results: list[Column | None]) -> Column:
    branch = None
    for r, result in zip(rules, results):
        result = F.lit(None).cast("string") if result is None else result
        branch = F.when(r.when, result) if branch is None else branch.when(r.when, result)
    return branch


def _by_name(check: Column, rules: list[Rule], results: list[Column | None]) -> Column:
    named = [Rule(r.name, r.severity, r.detail, check == r.name) for r in rules]
    return _cases(named, results)


def validate(
    records: DataFrame,
    as_of: Column | None = None,
    extra_checks: dict[str, list[Rule]] | None = None,
) -> DataFrame:
    """Adds ``check_*`` columns, ``failures`` (all of them, in check order), ``is_rejected``,
    ``defect_count`` (observations do not count) and the two flags served with a record.

    ``extra_checks`` is the extension point: more checks, each an ordered list of rules.
    """
    located = records.withColumn("zip_borough", geo.borough_of_zip(F.col("incident_zip")))
    checked = apply_checks(
        located, builtin_checks(as_of, records.columns) | (extra_checks or {})
    )
    return checked.withColumns(
        {
            "zip_borough_conflict": F.col("check_place").isNotNull(),
            "unrecognized_type": F.coalesce(
                F.col("check_category") == "complaint_type_unrecognized", F.lit(False)
            ),
        }
    )


def apply_checks(records: DataFrame, checks: dict[str, list[Rule]]) -> DataFrame:
    """Runs the given checks: ``check_*``, ``failures``, ``is_rejected``, ``defect_count``."""
    checked = records.withColumns(
        {
            f"check_{name}": _cases(rules, [F.lit(r.name) for r in rules])
            for name, rules in checks.items()
        }
    )

    failures, rejects, defects = [], [], []
    for name, rules in checks.items():
        column = F.col(f"check_{name}")
        severity = _by_name(column, rules, [F.lit(r.severity) for r in rules])
        failures.append(
            F.when(
                column.isNotNull(),
                F.array(
                    F.struct(
                        column.alias("rule"),
                        severity.alias("severity"),
                        _by_name(column, rules, [r.detail_column for r in rules]).alias("detail"),
                        _by_name(column, rules, [r.value for r in rules]).alias("field_value"),
                    )
                ),
            ).otherwise(F.array())
        )
        counted = [r.name for r in rules if r.severity in (REJECT, FLAG)]
        # Written over the record, not over the check column: a filter on ``is_rejected`` is
        # pushed towards the scan, and this way it takes only the rejecting conditions along.
        for i, r in enumerate(rules):
            if r.severity == REJECT:
                earlier = [~F.coalesce(e.when, F.lit(False)) for e in rules[:i]]
                rejects.append(reduce(and_, earlier, F.coalesce(r.when, F.lit(False))))
        if counted:
            defects.append(F.coalesce(column.isin(counted), F.lit(False)).cast("int"))
    return checked.withColumns(
        {
            # Joined, not filtered: what a filter of an array takes is interpreted.
            "failures": F.concat(*failures),
            "is_rejected": reduce(or_, rejects, F.lit(False)),
            "defect_count": reduce(add, defects, F.lit(0)),
        }
    )


def check_columns(validated: DataFrame) -> list[str]:
    return [c for c in validated.columns if c.startswith("check_")]


def failure_rows(validated: DataFrame, *carry: str) -> DataFrame:
    """One row per (record, failed rule)."""
    return validated.select(*carry, F.inline("failures"))


def any_failure(validated: DataFrame) -> Column:
    return reduce(or_, [F.col(c).isNotNull() for c in check_columns(validated)])


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(~F.col("is_rejected"))


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where("is_rejected")


def counters(validated: DataFrame) -> list[Column]:
    """Aggregates that count one batch.

    A record without a key counts as rejected and moves neither the update-time maximum nor the
    stored tables.
    """
    keyed = F.col("unique_key").isNotNull()
    kept = keyed & ~F.col("is_rejected")
    return [
        F.count(F.lit(1)).alias("rows_fetched"),
        F.count_if(~kept).alias("rows_rejected"),
        F.count_if(~keyed).alias("rows_keyless"),
        F.count_if(kept).alias("rows_accepted"),
        F.count_if(kept & any_failure(validated)).alias("rows_flagged"),
        F.count_if(kept & F.col("unrecognized_type")).alias("unrecognized_types"),
        F.max(F.when(keyed, F.col("source_updated_at"))).alias("max_updated_at"),
    ]


def run_counters(validated: DataFrame) -> DataFrame:
    """Row counters of one batch: a single aggregate, one row out."""
    return validated.agg(*counters(validated))


def observed(validated: DataFrame) -> tuple[DataFrame, Callable[[], dict]]:
    """``validated``, and what gives its counters once an action has run over all of it: they are taken
    as the rows go by, so no job is needed for them.

    Write the rows as they come, without a shuffle after: then each row is counted by the one task
    that writes it, also when others are repeated after a loss.
    """
    watch = Observation()
    # The time as a number, which needs no conversion on its way to the driver.
    *counts, newest = counters(validated)
    rows = validated.observe(watch, *counts, F.unix_micros(newest).alias("max_updated_us"))

    def told() -> dict:
        found = dict(watch.get)
        us = found.pop("max_updated_us")
        at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us) if us is not None else None
        return found | {"max_updated_at": at}

    return rows, told


def rule_counts(
    validated: DataFrame, extra_checks: dict[str, list[Rule]] | None = None
) -> DataFrame:
    """rule, severity, ord, failures for every registered rule and those of ``extra_checks``, as
    given to :func:`validate`; rules at zero included.

    Counts the check columns directly: one row per task is shuffled, nothing is exploded.
    """
    columns = ", ".join(check_columns(validated))
    known = [(name, severity) for name, severity, _ in fixed.RULES]
    added = [(r.name, r.severity) for rules in (extra_checks or {}).values() for r in rules]
    known += dict.fromkeys(a for a in added if a[0] not in dict(known))
    counts = validated.agg(
        *[F.expr(f"count_if('{name}' IN ({columns}))").alias(name) for name, _ in known]
    )
    rows = [
        F.expr(
            f"named_struct('rule', '{name}', 'severity', '{severity}', 'ord', {i}, 'failures', `{name}`)"
        )
        for i, (name, severity) in enumerate(known)
    ]
    return counts.select(F.inline(F.array(*rows)))


def replay(payloads: DataFrame, stored: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Rerun the rules on stored payloads and compare with the failures on record.

    ``payloads``: unique_key, payload (JSON). ``stored``: unique_key, rule. Gives one row per
    (unique_key, rule) with ``outcome`` fixed, new or same.
    """
    from tidemark.operators.standardize import standardize
    from tidemark.schema import FEED_SCHEMA

    feed = payloads.select(F.from_json("payload", FEED_SCHEMA).alias("r")).select("r.*")
    checked = validate(standardize(feed), as_of)
    # Names alone: the texts of the failures are not made.
    names = F.array_compact(F.array(*check_columns(checked)))
    now = checked.select("unique_key", F.explode(names).alias("rule")).withColumn("now", F.lit(1))
    before = stored.select("unique_key", "rule", F.lit(1).alias("before")).distinct()
    joined = before.join(now.distinct(), ["unique_key", "rule"], "full")
    outcome = (
        F.when(F.col("now").isNull(), "fixed").when(F.col("before").isNull(), "new").otherwise("same")
    )
    return joined.select("unique_key", "rule", outcome.alias("outcome"))
