"""The column functions on a streaming DataFrame give the batch answer."""

from pyspark.sql import functions as F

from epilode.functions import codes, dates, measures, text
from epilode.operators.columns import across_contains, keep_estimates, relabel


def transform(df):
    out = across_contains(df, "City", text.correct_town)
    out = out.withColumns(
        {
            "key": text.name_key(F.col("name")),
            "address": text.clean_address(F.col("name")),
            "band": measures.age_band(F.col("age")),
            "week": dates.week_start(F.to_date("day")),
            "race": codes.race_ethnicity(F.col("name"), F.col("name")),
            "plant": relabel(F.lower("HomeCity"), [("oak", "oak"), (".", "other")]),
        }
    )
    return keep_estimates(out, "variable")


def test_stream_equals_batch(spark, tmp_path):
    schema = "HomeCity string, name string, age double, day string, variable string"
    rows = [("Oaklawn", "John A", 25.0, "2024-01-01", "B1E"), ("Mt Prospect", "1 N Main", 81.0, "2024-01-07", "B1EA"),
            ("Elk Grove", ";2106-3;", None, "2024-02-01", "B1M")]
    batch = spark.createDataFrame(rows, schema)
    batch.write.json(str(tmp_path / "in"))
    stream = transform(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    query = (stream.writeStream.format("memory").queryName("cleaned")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("cleaned").collect()), key=str)
    assert got == sorted(map(tuple, transform(batch).collect()), key=str)
