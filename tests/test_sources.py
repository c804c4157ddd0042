"""What the sources must not lose: late bytes, late separators, rows like the header, over-long rows."""

import io
import zipfile

from tablemend.sources import charset, csv


def put(path, name, raw):
    (path / name).write_bytes(raw)
    return str(path / name)


def test_late_accent_decides_the_encoding(spark, tmp_path):
    body = "a,b\n" + "x,y\n" * 5000
    put(tmp_path, "late.csv", body.encode() + "café,z\n".encode("latin-1"))
    put(tmp_path, "wide.csv", body.encode() + "café,z\n".encode())
    put(tmp_path, "odd.csv", (body + "café,z\n").encode("utf-16"))
    found = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in csv.file_encodings(spark, str(tmp_path)).collect()}
    assert found == {"late.csv": "iso-8859-1", "wide.csv": "utf-8", "odd.csv": "utf-16"}
    rows = csv.scan_csv_folder(spark, f"{tmp_path}/*.csv")
    assert rows.filter("a = 'café'").count() == 3 and rows.count() == 3 * 5001


def test_separator_after_many_lines(spark, tmp_path):
    path = put(tmp_path, "s.csv", b"one;two\n" + b"1;2,5\n" * 60 + b"3;4\n" * 10)
    assert csv.sniff_separator(spark, path) == ";"


def test_rows_like_the_header_stay(spark, tmp_path):
    path = put(tmp_path, "h.csv", b"a,b\nx,y\na,b\nz,w\n")
    assert csv.scan_broken_csv(spark, path).count() == 3
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        archive.writestr("h.csv", "a,b\nx,y\na,b\nz,w\n")
    assert csv.scan_zip_csv(spark, put(tmp_path, "h.zip", packed.getvalue())).count() == 3


def test_long_rows_leave_whatever_their_last_named_cell(spark, tmp_path):
    path = put(tmp_path, "l.csv", b'a,b,c\n1,2,3\n4,5,,extra\n6,7\n"8,8",9\n1,2,3,4\n')
    assert sorted((r["a"], r["c"]) for r in csv.scan_csv(spark, path, infer=False).collect()) == [("1", "3"), ("6", None), ("8,8", None)]


def test_charsets_in_byte_ranges(spark, tmp_path):
    """Lines of any charset are cut alike whatever the ranges, each in the range it begins in."""
    lines = ["a,b", *(f"{i},{'äö€' if i % 3 else 'Ċč'}{'x' * (i % 7)}" for i in range(300)), "", "last,\u0a0d\u0d0a"]
    for name in ("utf-16", "utf-16-be", "utf-8", "cp1252"):
        text = "\r\n".join(lines) + "\n"
        raw = text.encode(name, "replace")
        raw = b"\xfe\xff" + raw if name == "utf-16-be" else raw
        path = put(tmp_path, f"{name}.csv", raw)
        wanted = raw.decode("utf-16" if name == "utf-16-be" else name).replace("\r\n", "\n").split("\n")[:-1]
        for size in (64, 1 << 20):
            found = charset.charset_lines(spark, [path], "utf-16" if name.startswith("utf-16") else name, size)
            rows = found.collect()
            assert [r["value"] for r in sorted(rows, key=lambda r: (r["split"], r["number"]))] == wanted
            assert len({r["split"] for r in rows}) > (20 if size == 64 else 0)


def test_windows_letters_tell_the_charset(spark, tmp_path):
    put(tmp_path, "w.csv", "a,b\n\u20ac 5,\u201cyes\u201d\n".encode("cp1252"))
    put(tmp_path, "l.csv", "a,b\ncafé,no\n".encode("latin-1"))
    found = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in csv.file_encodings(spark, str(tmp_path)).collect()}
    assert found == {"w.csv": "windows-1252", "l.csv": "iso-8859-1"}
    rows = csv.scan_csv_folder(spark, f"{tmp_path}/*.csv").collect()
    assert sorted((r["a"], r["b"]) for r in rows) == [("café", "no"), ("\u20ac 5", "\u201cyes\u201d")]
