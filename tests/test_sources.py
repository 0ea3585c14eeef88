from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seamark import session
from seamark.schema import METRICS, RAW_MESSAGE, struct, INT, DOUBLE
from seamark.sources import lookups, messages, results, tables


def message(**given):
    row = {f.name: None for f in RAW_MESSAGE.fields}
    row.update({"mmsi": 1, "timestamp": "07/04/2025 00:00:00", "destination": "DKCPH"}, **given)
    return tuple(row.values())


def test_daily_text_to_dated_parquet(spark, tmp_path):
    header = ",".join(RAW_MESSAGE.fieldNames())
    for day in (7, 8):
        lines = [header]
        for hour in (1, 2):
            row = message(timestamp=f"{day:02d}/04/2025 {hour:02d}:00:00", to_bow="12.5", imo="Unknown")
            lines.append(",".join("" if v is None else str(v) for v in row))
        (tmp_path / f"day{day}.csv").write_text("\n".join(lines))
    raw = messages.read_daily_text(spark, str(tmp_path / "day*.csv"))
    typed = messages.typed(raw)
    out = str(tmp_path / "dated")
    messages.write_messages(typed, out)
    messages.write_messages(typed, out)  # a second run replaces the days
    back = messages.read_messages(spark, out)
    assert back.count() == 4
    assert {str(r.date) for r in back.select("date").distinct().collect()} == {"2025-04-07", "2025-04-08"}
    assert back.select("to_bow", "imo").distinct().collect() == [(13, None)]
    pruned = back.where(F.col("date") == "2025-04-07")
    assert "PartitionFilters: [isnotnull(date" in pruned._jdf.queryExecution().toString()


def test_clean_keeps_known_ports(spark):
    rows = [message(), message(mmsi=None), message(destination="XX")]
    typed = messages.typed(spark.createDataFrame(rows, RAW_MESSAGE))
    ports = spark.createDataFrame([("DKCPH",)], "port_code string")
    assert messages.clean(typed).count() == 2
    assert messages.clean(typed, ports).count() == 1


def test_lenient_dates(spark):
    typed = messages.typed(spark.createDataFrame([message(eta="31/02/2025 10:00:00")], RAW_MESSAGE), strict=False)
    assert typed.first().eta is None and typed.first().timestamp == datetime(2025, 4, 7)


def test_country_rows_quoted_as_a_whole(spark, tmp_path):
    path = tmp_path / "countries.csv"
    path.write_text(
        'CountryCode,CountryName\nAD,Andorra\nNA,Namibia\nCI,Côte d\'Ivoire\n'
        '"BO,""Bolivia, Plurinational State of"""\n"XX","A, B"\n'
    )
    found = dict(map(tuple, lookups.read_countries(spark, str(path)).collect()))
    assert found == {
        "AD": "Andorra",
        "NA": "Namibia",
        "CI": "Côte d'Ivoire",
        "BO": "Bolivia, Plurinational State of",
        "XX": "A, B",
    }


def test_ports(spark, tmp_path):
    path = tmp_path / "ports.csv"
    path.write_text('port_id,port_code,port_name,country_code,country_name,polygon\n1,DKCPH,"K, H",DK,,"POLYGON ((1 2, 3 4))"\n')
    row = lookups.read_ports(spark, str(path)).first()
    assert (row.port_id, row.port_name, row.country_name, row.polygon) == (1, "K, H", None, "POLYGON ((1 2, 3 4))")


def test_table_modes(spark, tmp_path):
    folder, one = str(tmp_path), spark.range(3)
    tables.write_table(one, folder, "t", sort=["id"])
    tables.write_table(one, folder, "t", sort=["id"])
    assert tables.read_table(spark, folder, "t").count() == 3
    tables.write_table(spark.range(5), folder, "t", mode="ignore")
    assert tables.read_table(spark, folder, "t", schema=one.schema, columns=["id"]).count() == 3


def test_catalog_tables_and_views(spark):
    tables.save_catalog_table(spark.range(2).select(F.col("id").cast("int").alias("a")), "kept_table")
    tables.save_catalog_table(spark.range(9).select(F.col("id").cast("int").alias("a")), "kept_table")
    assert spark.table("kept_table").count() == 2
    tables.insert_into(spark.createDataFrame([(7,)], "x long"), "kept_table")
    assert tables.scalar(spark.sql("SELECT max(a) FROM kept_table")) == 7
    tables.save_catalog_table(spark.range(1), "kept_table", replace=True)
    assert spark.table("kept_table").count() == 1
    tables.register_views({"some_view": spark.range(4)})
    assert {"kept_table", "some_view"} <= {r.name for r in tables.list_tables(spark).collect()}
    assert tables.query(spark, "SELECT * FROM some_view WHERE id >= :low", low=2).count() == 2
    spark.sql("DROP TABLE kept_table")


def test_series_round_trip(spark, tmp_path):
    for run in ("graph_a", "run b"):
        losses = spark.createDataFrame([(1, 0.5), (0, 0.7)], "epoch int, val_loss double")
        results.write_series(losses, str(tmp_path / run / "val_loss.csv"))
        (tmp_path / run / "plain").mkdir()
        (tmp_path / run / "plain" / "val_metrics.csv").write_text(
            "epoch,average_precision,accuracy,f1,roc_auc\n0,0.1,0.2,0.3,0.4\n"
        )
    read = results.read_losses(spark, str(tmp_path / "*" / "val_loss.csv"), "val").orderBy("run", "epoch").collect()
    assert [tuple(r) for r in read] == [("graph_a", 0, 0.7), ("graph_a", 1, 0.5), ("run b", 0, 0.7), ("run b", 1, 0.5)]
    found = results.read_metrics(spark, str(tmp_path / "*" / "plain" / "val_metrics.csv"))
    assert found.columns == ["run", "epoch", *METRICS] and {r.run for r in found.collect()} == {"plain"}


def test_predictions_and_parameters(spark, tmp_path):
    scored = spark.createDataFrame([(1, 0.4), (0, -2.0)], "shiptype int, logit double").coalesce(1)
    results.write_predictions(scored, str(tmp_path), "binary_classification", "shiptype", "logit")
    read = spark.read.option("header", True).csv(str(tmp_path / "test_predictions.csv"))
    assert sorted(r.predictions for r in read.collect()) == ["0", "1"]
    assert spark.read.option("header", True).csv(str(tmp_path / "test_targets.csv")).columns == ["shiptype"]
    many = spark.createDataFrame([(2, [0.1, 0.2, 0.9])], "y int, p array<double>")
    results.write_predictions(many, str(tmp_path / "m"), "multiclass_classification", "y", "p")
    assert spark.read.option("header", True).csv(str(tmp_path / "m" / "test_predictions.csv")).first()[0] == "2"
    schema = struct(("n_epochs", INT), ("learning_rate", DOUBLE))
    results.write_parameters(spark.createDataFrame([(150, 5e-5)], schema), str(tmp_path / "best"))
    assert tuple(results.read_parameters(spark, str(tmp_path / "best"), schema).first()) == (150, 5e-5)


def test_shared_folder_is_the_one_the_session_names(spark):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    stored = session.write_out(spark.range(3), "three")
    assert stored.count() == 3 and spark.conf.get("spark.checkpoint.dir") in stored.inputFiles()[0]


def test_unknown_task_type(spark):
    with pytest.raises(KeyError):
        results.write_predictions(spark.range(1), "unused", "ranking", "id", "id")


def test_scratch_leaves_nothing_behind(spark):
    folder = Path(session.shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    with session.scratch(spark):
        kept = session.write_out(spark.range(5), "five")
        assert kept.count() == 5 and len(set(folder.iterdir()) - before) == 1
    assert set(folder.iterdir()) == before
