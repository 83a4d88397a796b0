import os

import pytest

from varscope.sources.csv_ingest import UnsupportedFileFormatError, file_formats, import_file


def _write(tmp_path, name, text, encoding="utf-8"):
    p = os.path.join(tmp_path, name)
    with open(p, "wb") as f:
        f.write(text.encode(encoding))
    return p


def test_semicolon_decimal_comma(spark, tmp_path):
    p = _write(str(tmp_path), "a.csv", "Prix;Ville\n12,50;Paris\n1 234,5;Lyon\n3;Nice\n")
    df = import_file(spark, p)
    assert dict(df.dtypes)["Prix"] == "double"
    assert [r["Prix"] for r in df.collect()] == [12.5, 1234.5, 3.0]


def test_na_markers(spark, tmp_path):
    lines = ["id,val"] + [f"{i},{'N/D' if i % 5 == 0 else i * 1.5}" for i in range(30)]
    df = import_file(spark, _write(str(tmp_path), "b.csv", "\n".join(lines) + "\n"))
    assert dict(df.dtypes)["val"] == "double" and dict(df.dtypes)["id"] == "bigint"
    assert df.where("val IS NULL").count() == 6


def test_comma_delimiter_with_decimal_comma_is_refused(spark, tmp_path):
    p = _write(str(tmp_path), "c.csv", "a,b\n1,5,2\n3,4\n")
    with pytest.raises(UnsupportedFileFormatError):
        import_file(spark, p)


def test_single_column_and_cp1252(spark, tmp_path):
    one = import_file(spark, _write(str(tmp_path), "d.csv", "valeur\n1\n2\n3\n"))
    assert one.columns == ["valeur"] and one.count() == 3
    cp = import_file(spark, _write(str(tmp_path), "e.csv", "Ville;Prix\nBéziers;10\nÉvreux;12\n", "cp1252"))
    assert [r["Ville"] for r in cp.collect()] == ["Béziers", "Évreux"]


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        import_file(spark, os.path.join(str(tmp_path), "missing.csv"))
    p = _write(str(tmp_path), "f.xyz", "a\n1\n")
    with pytest.raises(UnsupportedFileFormatError):
        import_file(spark, p)


def test_long_digit_strings_stay_text(spark, tmp_path):
    p = _write(str(tmp_path), "long.csv", "id,n\n12345678901234567890123,1\n98765432109876543210987,9223372036854775807\n")
    df = import_file(spark, p)
    assert dict(df.dtypes) == {"id": "string", "n": "bigint"}
    assert {r["id"] for r in df.collect()} == {"12345678901234567890123", "98765432109876543210987"}


def _folder(tmp_path, name):
    p = os.path.join(str(tmp_path), name)
    os.makedirs(p)
    return p


def test_folder_of_two_encodings_and_delimiters(spark, tmp_path):
    p = _folder(tmp_path, "mixed.csv")
    _write(p, "a.csv", "Ville;Prix\nBéziers;10,5\n\"Le Puy; haut\";1 012\n")
    _write(p, "b [1]*.csv", "Ville,Prix\nÉvreux,12.25\n", "cp1252")
    _write(p, "c.csv", "Prix\tVille\n7\t\"dit \"\"l'Œil\"\"\"\n")
    _write(p, "empty.csv", "\n  \n")
    got = {f["file"].rsplit("/", 1)[1]: (f["encoding"], f["delimiter"], f["n_lines"]) for f in file_formats(spark, p).collect()}
    assert got == {"a.csv": ("utf-8", ";", 3), "b%20%5B1%5D*.csv": ("cp1252", ",", 2), "c.csv": ("utf-8", "\t", 2)}
    df = import_file(spark, p)
    assert dict(df.dtypes) == {"Ville": "string", "Prix": "double"}
    assert {(r["Ville"], r["Prix"]) for r in df.collect()} == {("Béziers", 10.5), ("Le Puy; haut", 1012.0), ("Évreux", 12.25),
                                                               ("dit \"l'Œil\"", 7.0)}


def test_headers_differ_by_file(spark, tmp_path):
    p = _folder(tmp_path, "headers.csv")
    _write(p, "a.csv", "x,y\n1,2\n")
    _write(p, "b.csv", "y,x,z\n4,3,5\n")
    assert {(r["x"], r["y"], r["z"]) for r in import_file(spark, p).select("x", "y", "z").collect()} == {(1, 2, None), (3, 4, 5)}


def test_quoted_delimiters_anywhere(spark, tmp_path):
    lines = ["id,text"] + [f"{i},plain" for i in range(40)] + ['40,"one, two"', '41,5" pipe', '42,"say ""a, b"", c"']
    df = import_file(spark, _write(str(tmp_path), "quoted.csv", "\n".join(lines) + "\n"))
    assert {r["text"] for r in df.where("id >= 40").collect()} == {"one, two", '5" pipe', 'say "a, b", c'}


def test_bytes_without_a_character_are_refused(spark, tmp_path):
    p = os.path.join(str(tmp_path), "bytes.csv")
    with open(p, "wb") as f:
        f.write(b"a;b\n\x81;\xe9\n")
    with pytest.raises(UnsupportedFileFormatError):
        import_file(spark, p)
    with pytest.raises(UnsupportedFileFormatError):
        import_file(spark, _write(str(tmp_path), "blank.csv", "\n \n"))


def test_long_file_header_is_the_first_line(spark, tmp_path):
    """A file in many blocks: the header comes from the first one."""
    p = _write(str(tmp_path), "long_file.csv", "key;v\n" + "".join(f"{i};{i},5\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        f = file_formats(spark, p).first()
        assert (f["header"], f["delimiter"], f["n_lines"]) == ("key;v", ";", 20_001)
        assert import_file(spark, p).agg({"v": "sum"}).first()[0] == sum(i + 0.5 for i in range(20_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
