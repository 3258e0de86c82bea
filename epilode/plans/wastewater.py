"""Raw wastewater samples to one normalised row per site and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilode.functions import fixed_values as V
from epilode.functions.measures import normalize_flow
from epilode.operators.aggregates import first_per_group, site_means
from epilode.operators.columns import relabel
from epilode.operators.joins import null_safe_join
from epilode.operators.ordered import align_late_site, first_row, keep_complete, late_dates
from epilode.session import cut_lineage


def label_plants(raw: DataFrame, county: int = V.PLANT_COUNTY, location: str = V.PLANT_LOCATION) -> DataFrame:
    """Samples of the county's plants with display and short names."""
    name = F.lower("wwtp_name")
    return raw.filter(
        (F.col("county_names") == F.lit(str(county))) & (F.col("sample_location") == location)
    ).withColumns(
        {
            "wwtp_name": name,
            "display_name": relabel(name, [(p, d) for p, d, _ in V.PLANTS]),
            "short_name": relabel(name, [(p, s) for p, _, s in V.PLANTS]),
        }
    )


def normalise_sites(samples: DataFrame, targets: dict[str, str], site: str = "short_name",
                    date: str = "sample_collect_date", time: str = "sample_collect_time",
                    marker: str = "pmmov_copies_l_wastewater", flow: str = "flow_rate",
                    tie: str = "ordinal", late_site: str = V.LATE_SITE, sites: int = V.SITE_COUNT) -> DataFrame:
    """One row per site and day on days all sites report, targets normalised.

    Late days are found on the raw rows, before one sample per day is kept; a
    moved sample can make a day overfull, and such a day is dropped.
    """
    late = late_dates(samples, site, date, late_site, sites - 1)
    needed = [site, date, time, tie, marker, flow, *targets.values()]
    one = first_row(samples.select(*dict.fromkeys(needed)), [site, date], [F.col(time).asc_nulls_last(), F.col(tie).asc()])
    # One row per site and day from here on: small, and read several times.
    one = cut_lineage(one.withColumn("__own_date", F.col(date)), "daily_samples")
    aligned = align_late_site(one, late, site, date, late_site)
    complete = keep_complete(aligned, date, sites)
    means = site_means(complete, site, {marker: "marker_mean", flow: "flow_mean"})
    daily = first_per_group(complete, [site, date], ["__own_date"], [*targets.values(), marker])
    rows = null_safe_join(daily, means, [site])
    return rows.withColumns(
        {
            f"{t}_flow_pmmov_norm_site": normalize_flow(
                F.col(c), F.col("flow_mean"), F.col("marker_mean"), F.col(marker)
            )
            for t, c in targets.items()
        }
    )


def prepare(raw: DataFrame) -> DataFrame:
    """The whole preparation of a raw extract, under the names of the published table."""
    return normalise_sites(label_plants(raw), V.WASTEWATER_TARGETS).withColumnsRenamed(V.WASTEWATER_NAMES)
