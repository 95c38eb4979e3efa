import hashlib
import os
import zipfile

import pytest
from conftest import rows

from caudal import cli
from caudal.sources import catalog, readers, sinks

D = readers.Dataset({"id": ("ID", "text"), "n": ("Valor", "long"), "f": ("Fecha", "date")}, ("id",))


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ID": "x", "Valor": "12.7", "Otra": 1}\nno json\n{"ID": "N/A", "Fecha": "2025-13-01"}\n')
    assert rows(readers.read_ndjson(spark, str(tmp_path / "a.json"), D)) == sorted([("x", 13, None), (None, None, None)], key=repr)
    (tmp_path / "b.json").write_text('[{"ID": "x"},\n {"ID": "y"}]')
    assert rows(readers.read_json_array(spark, str(tmp_path / "b.json"), D).select("id")) == [("x",), ("y",)]


def test_parquet(spark, tmp_path):
    df = spark.createDataFrame([(i, [i, i]) for i in range(10)], "a int, b array<int>")
    assert sinks.write_parquet(df, str(tmp_path / "t"), rows_per_file=3)
    assert not sinks.write_parquet(df, str(tmp_path / "t"), resume=True)
    files = [str(tmp_path / "t" / f) for f in os.listdir(tmp_path / "t") if f.endswith(".parquet")]
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 cut off")
    assert readers.read_parquets(spark, [*files, str(tmp_path / "bad.parquet")], local=True).count() == 10
    with pytest.raises(FileNotFoundError):
        readers.read_parquets(spark, [str(tmp_path / "bad.parquet")], local=True)
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).where("b = '[3,3]'").count() == 1
    sinks.write_sorted(df.drop("b"), str(tmp_path / "s"), "a")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 10


def test_days_and_markdown(spark):
    assert readers.days(spark, "2025-01-30", "2025-02-02").count() == 3
    assert sinks.to_markdown(spark.createDataFrame([("a|b", 1234.5)], "t string, x double")) == "| t | x |\n|---|---:|\n| a\\|b | 1.234,5 |\n"
    with pytest.raises(ValueError):
        sinks.to_markdown(spark.range(5), most=3)


def test_anonymised(spark):
    df = spark.createDataFrame([("a", 1, "s"), ("z", 2, "s")], "k string, v int, secret string")
    assert rows(sinks.anonymised(df, ["k"], spark.createDataFrame([("a", "A-1")], "id string, nuevo string"), ["secret"])) == [("A-1", 1)]


def test_restore(tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/a.txt", "hola")
    right = {"d/a.txt": hashlib.sha256(b"hola").hexdigest()}
    assert len(readers.restore([tmp_path / "z.zip"], str(tmp_path / "out"), right)) == 1
    with pytest.raises(ValueError):
        readers.restore([tmp_path / "z.zip"], str(tmp_path / "other"), {"d/a.txt": "0"})
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("../a.txt", "x")
    with pytest.raises(ValueError):
        readers.restore([tmp_path / "e.zip"], str(tmp_path / "out"), {})


def test_catalog(spark, data):
    assert catalog.mount(spark, data, ["nation", "region"]) == ["nation", "region"]
    with pytest.raises(FileNotFoundError):
        catalog.mount(spark, data, ["missing"])
    v = catalog.Views(spark)
    v.add("big", ("nation",), lambda n: n.where("n_nationkey > 3"))
    v.add("bigger", ("big", "region"), lambda b, r: b.join(r, b["n_regionkey"] == r["r_regionkey"]))
    v.add("lost", ("nowhere",), lambda x: x)
    assert v.get("bigger").count() == 21 and v.ready() == {"big": True, "bigger": True, "lost": False}
    with pytest.raises(KeyError):
        v.get("lost")


def test_cli(spark, data, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "cri_supplier" in capsys.readouterr().out
    assert cli.main(["run", "edge_type_counts", "--data", data, "--out", str(tmp_path), "--markdown"]) == 0
    assert "adjudica" in capsys.readouterr().out
    assert cli.main(["run", "edge_type_counts", "--data", data, "--out", str(tmp_path), "--resume"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["run", "nothing"])
