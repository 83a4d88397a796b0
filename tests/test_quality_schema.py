from conftest import frame
from varscope.operators.quality import duplicate_count, duplicate_rows, null_counts, validate_dataset
from varscope.operators.schema import column_types, legitimate_numeric_columns, temporal_columns


def test_nulls_and_duplicates_ignore_identifiers(spark):
    df = frame(spark, {"id": [1, 2, 3, 4, 5, 6],
                       "ville": ["Paris", "Lyon", None, "Paris", "Lyon", "Paris"],
                       "prix": [10, 20, 30, 10, 20, 10],
                       "quantite": [1.0, 2.0, float("nan"), 1.0, 2.0, None]},
               "id long, ville string, prix long, quantite double")
    nc = {r["column"]: r["n_null"] for r in null_counts(df).collect()}
    assert nc == {"id": 0, "ville": 1, "prix": 0, "quantite": 2}
    v = validate_dataset(df).first()
    assert v["n_rows"] == 6 and v["n_columns"] == 4 and v["n_null_cells"] == 3
    assert v["duplicates_count"] >= 1


def test_duplicates_with_identifier_and_all_identifier_table(spark):
    df = frame(spark, {"Identifiant": [1, 2, 3, 4, 5], "a": ["x", "y", "x", "z", "w"], "b": [1, 2, 1, 3, 4]})
    assert validate_dataset(df).first()["duplicates_count"] == 1
    ids = frame(spark, {"u": [1, 2, 3, 4, 5], "v": [10, 11, 12, 13, 14]})
    assert validate_dataset(ids).first()["duplicates_count"] == 0
    assert duplicate_count(df, ["a", "b"]).first()["duplicates_count"] == 1
    assert [r["Identifiant"] for r in duplicate_rows(df, ["a", "b"], ["Identifiant"]).collect()] == [3]


def test_duplicate_rows_with_ties(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "x", 1.0), (2, "x", 2.0), (1, "y", 3.0), (None, "z", 1.0), (None, "z", 2.0)],
                               "k int, g string, v double")
    rows = duplicate_rows(df, ["g"], ["k"]).collect()
    assert len(rows) == duplicate_count(df, ["g"]).first()["duplicates_count"] == 3
    assert sorted(r["g"] for r in rows) == ["x", "x", "z"]


def test_column_roles(spark):
    df = frame(spark, {
        "Ventes": [10, 12, 15, 11, 9, 14, 13, 12, 10, 11],
        "Produit": ["A", "B", "C", "A", "B", "C", "A", "B", "C", "A"],
        "Promotion": ["Oui", "Non", "Oui", "Non", "Oui", "Non", "Oui", "Non", "Oui", "Non"],
        "Flag": [0, 1, 0, 1, 1, 0, 0, 1, 0, 1],
        "Temperature": [1.5, 2.25, 3.0, 4.1, 5.2, 6.3, 7.4, 8.5, 9.6, 10.7],
        "Animal": [f"A{i:03d}" for i in range(10)],
        "Date": [f"2024-01-{i + 1:02d}" for i in range(10)],
        "Note": ["bien", "bien", "moyen", "top", "nul", "ok", "ok", "super", "bof", "bien"],
    })
    roles = {r["column"]: r["role"] for r in column_types(df).collect()}
    assert roles == {"Ventes": "numeric_discrete", "Produit": "categorical", "Promotion": "boolean",
                     "Flag": "boolean", "Temperature": "numeric_continuous", "Animal": "identifier",
                     "Date": "datetime", "Note": "text_free"}


def test_boolean_columns_and_text_dates(spark):
    df = spark.createDataFrame(
        [(bool(i % 2), True, f"{m} {i + 1}, 2024", f"2024-01-{i + 1:02d}T10:00:0{i}.25Z", f"2024-03-0{i + 1} 08:30:00+02:00")
         for i, m in enumerate(["January", "March", "May", "June", "July", "August"])],
        "flag boolean, always boolean, named string, iso string, zoned string")
    roles = {r["column"]: r["role"] for r in column_types(df).collect()}
    assert roles == {"flag": "boolean", "always": "numeric_discrete", "named": "datetime", "iso": "datetime", "zoned": "datetime"}


def test_identifiers_excluded_from_legitimate_numeric(spark):
    n = 30
    df = frame(spark, {"seq": list(range(1, n + 1)), "seq2": list(range(-12, n - 12)),
                       "smooth": [15 + 0.3 * i for i in range(n)], "y": [float(i % 7) for i in range(n)]})
    assert legitimate_numeric_columns(df) == ["smooth", "y"]


def test_temporal_columns(spark):
    df = frame(spark, {"Mois": [1, 2, 3], "orderDate": ["a", "b", "c"], "Prix_Jour": [1.5, 2.5, 3.5],
                       "semaine": [1, 2, 3], "Autre": [1, 2, 3]})
    assert temporal_columns(df) == ["Mois", "orderDate", "semaine"]


def test_sequential_in_order_across_partitions(spark):
    from varscope.operators.schema import sequential_in_order
    rows = [("a", k, 1000 - k) for k in range(200)] + [("b", k, k * 2) for k in range(50)]
    df = spark.createDataFrame(rows, "seg string, k long, x long").repartition(5)
    got = {r["seg"]: r["is_sequential"] for r in sequential_in_order(df, "x", "k", by=["seg"], n_partitions=7).collect()}
    assert got == {"a": True, "b": False}
    broken = spark.createDataFrame([(k, k if k != 30 else 99) for k in range(60)], "k long, x long")
    assert sequential_in_order(broken, "x", "k", n_partitions=4).first()["is_sequential"] is False
    ties = spark.createDataFrame([(k // 2, k) for k in range(10)], "k long, x long")
    assert sequential_in_order(ties, "x", "k").first()["is_sequential"] is False
