import io
import json
import struct
import wave
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.feather as feather
import pyarrow.ipc as ipc
import pyarrow.parquet as pq
import pytest

from conftest import rows
from tabforge.sources import audio, database, documents, excel, files, images, kafka


# --- table files ---

def test_csv_json_parquet(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,label\n1.0,x,0\n2.0,y,1\n3.0,z,0\n")
    (tmp_path / "t.json").write_text(json.dumps([{"a": 1.0, "b": "x", "label": 0}, {"a": 2.0, "b": "y", "label": 1}]))
    (tmp_path / "t.jsonl").write_text('{"a": 1.0, "b": "x"}\n{"a": 2.0, "b": "y"}\n')
    pd.DataFrame({"a": [1.0, 2.0], "b": [3.0, 4.0], "label": [0, 1]}).to_parquet(tmp_path / "t.parquet")
    csv = files.read_table(spark, str(tmp_path / "t.csv"))
    assert csv.columns == ["a", "b", "label"] and csv.count() == 3
    assert dict(csv.dtypes) == {"a": "double", "b": "string", "label": "int"}
    assert files.read_table(spark, str(tmp_path / "t.json")).count() == 2
    assert files.read_table(spark, str(tmp_path / "t.jsonl")).count() == 2
    assert files.read_table(spark, str(tmp_path / "t.parquet")).count() == 2


@pytest.mark.parametrize("text, n", [
    ('{ "a": 1,\n  "b": 2 }', 1), ('{"a": 1, "b": 2}', 1), ('{"a": 1, "b": 2}\n{"a": 3, "b": 4}\n', 2),
    ('\n [{"a": 1, "b": 2},\n {"a": 3, "b": 4}]', 2), ('{"a": 1, "b": "' + "x" * 9000 + '"}\n{"a": 2}', 2),
])
def test_json_layouts(spark, tmp_path, text, n):
    (tmp_path / "t.json").write_text(text)
    df = files.read_json(spark, str(tmp_path / "t.json"))
    assert df.count() == n and df.columns == ["a", "b"]


def test_quoted_line_breaks_need_multi_line(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n')
    assert rows(files.read_csv(spark, str(tmp_path / "t.csv"), multiLine=True)) == [(1, "x\ny")]


def test_unknown_suffix_is_csv(spark, tmp_path):
    (tmp_path / "t.data").write_text("a,b\n1,2\n")
    assert rows(files.read_table(spark, str(tmp_path / "t.data"))) == [(1, 2)]


def test_globs(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for i in range(3):
        (tmp_path / f"part{i}.csv").write_text(f"x\n{i}\n")
    (tmp_path / "deep" / "part9.csv").write_text("x\n9\n")
    assert rows(files.read_table(spark, str(tmp_path / "part*.csv"))) == [(0,), (1,), (2,)]
    assert rows(files.read_table(spark, f"{tmp_path}/**/*.csv")) == [(0,), (1,), (2,), (9,)]


def test_missing_path_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.read_table(spark, str(tmp_path / "none.csv")).count()
    with pytest.raises(ValueError):
        files.read_table(spark, [])


def test_stack_widens_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,10\n")
    (tmp_path / "b.csv").write_text("v,w\nabc,2.5\n")
    df = files.read_table(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert df.columns == ["k", "v", "w"]
    assert rows(df) == sorted([(1, "10", None), (None, "abc", 2.5)], key=repr)


@pytest.mark.parametrize("kind", ["file", "stream", "feather1"])
def test_arrow_layouts(spark, tmp_path, kind):
    table = pa.table({"a": list(range(100)), "s": [str(i) for i in range(100)]})
    path = str(tmp_path / "t.arrow")
    if kind == "file":
        with ipc.new_file(path, table.schema) as w:
            w.write_table(table, max_chunksize=30)
    elif kind == "stream":
        with ipc.new_stream(path, table.schema) as w:
            w.write_table(table)
    else:
        feather.write_feather(table, path, version=1)
    assert rows(files.read_table(spark, path)) == sorted(((i, str(i)) for i in range(100)), key=repr)


def test_object_store_settings(spark, tmp_path):
    assert files.build_object_url("s3a", "bucket", "/data/file.csv") == "s3a://bucket/data/file.csv"
    got = {p: files.detect_path_format(p) for p in ("a/*.parquet", "events.json", "e.jsonl", "t.arrow", "data.txt")}
    assert list(got.values()) == ["parquet", "json", "json", "arrow", "csv"]
    env = {"AWS_ACCESS_KEY_ID": "env", "AWS_SECRET_ACCESS_KEY": "s"}
    opts = files.s3_options({"aws_access_key_id": "cfg", "endpoint_url": "http://minio:9000"}, env)
    assert opts["fs.s3a.access.key"] == "cfg" and opts["fs.s3a.secret.key"] == "s"
    assert opts["fs.s3a.path.style.access"] == "true" and opts["fs.s3a.connection.ssl.enabled"] == "false"
    assert opts["fs.s3a.endpoint.region"] == "us-east-1"
    assert files.gcs_access({"hmac_access_key": "k", "hmac_secret": "s"}, {})[0] == "s3a"
    assert files.gcs_access({"service_account_key_path": "/k.json"}, {})[1][
        "fs.gs.auth.service.account.json.keyfile"] == "/k.json"
    (tmp_path / "x.json").write_text('{"v": 1}\n{"v": 2}\n')
    assert files.read_object_store(spark, "file", "", f"{tmp_path}/*.json").count() == 2


def test_file_inventory(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes(b"x" * 1536)
    (tmp_path / "a.txt").write_bytes(b"x" * 100)
    assert [tuple(r) for r in files.file_inventory(spark, str(tmp_path)).collect()] == [("a.txt", 0.1), ("b.txt", 1.5)]


# --- databases and Kafka: options only, no server here ---

def test_jdbc_options(monkeypatch):
    monkeypatch.setenv("DB_PASS", "p%40ss")
    got = database.jdbc_options("postgresql+psycopg2://u:${DB_PASS}@h:5433/db?sslmode=require", "SELECT 1;")
    assert got == {"url": "jdbc:postgresql://h:5433/db?sslmode=require", "user": "u", "password": "p@ss",
                   "dbtable": "(SELECT 1) q", "fetchsize": "10000"}
    assert database.jdbc_connection("sqlite:////tmp/x.db") == {"url": "jdbc:sqlite:/tmp/x.db"}
    assert database.jdbc_connection("mssql://h/db")["url"] == "jdbc:sqlserver://h;databaseName=db"
    assert database.jdbc_connection("jdbc:derby:memory:x") == {"url": "jdbc:derby:memory:x"}
    ranged = database.jdbc_options("jdbc:x", "q", partition_column="id", lower_bound=0, upper_bound=9, num_partitions=3)
    assert ranged["numPartitions"] == "3"
    with pytest.raises(ValueError):
        database.jdbc_options("jdbc:x", "q", partition_column="id")
    with pytest.raises(ValueError):
        database.jdbc_connection("oracle://h/db")


def test_kafka_options():
    got = kafka.kafka_options("t", "h:1", batch_size=5, group_id="g")
    assert got == {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "earliest",
                   "maxOffsetsPerTrigger": "5", "kafka.group.id": "g"}


# --- workbooks ---

def test_workbook_types(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>num</t></is></c>'
        '<c r="C1" t="str"><v>day</v></c><c r="D1" t="inlineStr"><is><t>ok</t></is></c></row>'
        '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>1.5</v></c><c r="C2" s="1"><v>45292</v></c>'
        '<c r="D2" t="b"><v>1</v></c></row>'
        '<row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"><v>2</v></c><c r="D3" t="b"><v>0</v></c></row>')
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/'
                   'officeDocument/2006/relationships"><sheets><sheet name="x" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/'
                   'relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><t>ann</t></si>'
                   '<si><r><t>b</t></r><r><t>ob</t></r></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/>'
                   '</cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
    df = excel.read_excel(spark, str(tmp_path / "b.xlsx"))
    assert dict(df.dtypes) == {"name": "string", "num": "double", "day": "timestamp_ntz", "ok": "boolean"}
    got = {r.name: r for r in df.collect()}
    assert got["ann"].num == 1.5 and str(got["ann"].day) == "2024-01-01 00:00:00" and got["ann"].ok is True
    assert got["bob"].num == 2.0 and got["bob"].day is None


# --- documents ---

def _docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/'
                   f'main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_document_folder(spark, tmp_path):
    for label in ("positive", "negative"):
        (tmp_path / label).mkdir()
        for i in range(3):
            (tmp_path / label / f"d{i}.txt").write_text(f"  {label} text {i}\r\nsecond line\u2003\n")
    (tmp_path / "positive" / "empty.md").write_text(" \n\t")
    (tmp_path / "positive" / "bad.rst").write_bytes(b"caf\xff")
    (tmp_path / "negative" / "word.docx").write_bytes(_docx("One", "  ", "Two"))
    (tmp_path / "negative" / "broken.docx").write_bytes(b"nope")
    (tmp_path / "negative" / "skip.bin").write_bytes(b"nope")
    (tmp_path / "negative" / "UPPER.TXT").write_text("loud")
    df = documents.read_documents(spark, str(tmp_path), label_from_dir=True)
    got = {(r.label, r.filename): r for r in df.collect()}
    assert len(got) == 10
    first = got["positive", "d0.txt"]
    assert first.text == "positive text 0\nsecond line" and first.char_count == len(first.text)
    assert first.source == str(tmp_path / "positive" / "d0.txt")
    assert got["positive", "bad.rst"].text == "caf\ufffd"
    assert got["negative", "word.docx"].text == "One\nTwo" and got["negative", "word.docx"].char_count == 7
    broken = got["negative", "broken.docx"]
    assert broken.text.startswith("[ERROR: ") and broken.char_count == 0


def test_pdf_extractor_can_be_supplied(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|| |two")

    def pages(blob):
        parts = blob.decode().split("|")
        return [(i, len(parts), p) for i, p in enumerate(parts, 1)]

    df = documents.read_documents(spark, str(tmp_path), extractors={".pdf": pages})
    assert rows(df.select("page", "total_pages", "text")) == [(1, 4, "one"), (4, 4, "two")]


def test_files_of_all_kinds_are_planned_once(spark, tmp_path):
    texts = {"a/x.txt": b" one\r\n", "a/y.docx": _docx("One", "Two"), "b/z.docx": b"nope", "b/w.bin": b"nope", "b/v.md": b" \n",
             "b/u.pdf": b"p|| q"}
    frame = spark.createDataFrame([(f"file:/d/{k}", bytearray(v)) for k, v in texts.items()] + [
        ("file:/d/n.txt", None), ("file:/d/m.docx", None), (None, bytearray(b"x"))], "path string, content binary")
    frame.write.parquet(f"{tmp_path}/files")
    pages = lambda blob: [(i, 3, t) for i, t in enumerate(blob.decode().split("|"), 1)]
    df = documents.parse_documents(spark.read.parquet(f"{tmp_path}/files"), label_from_dir=True, extractors={".pdf": pages})
    got = sorted(map(tuple, df.select("filename", "page", "total_pages", "text", "char_count", "label").collect()))
    assert [r for r in got if not r[3].startswith("[ERROR: ")] == [
        ("u.pdf", 1, 3, "p", 1, "b"), ("u.pdf", 3, 3, "q", 1, "b"), ("x.txt", 1, 1, "one", 3, "a"), ("y.docx", 1, 1, "One\nTwo", 7, "a")]
    assert [(r[0], r[4]) for r in got if r[3].startswith("[ERROR: ")] == [("m.docx", 0), ("z.docx", 0)]
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert documents.parse_documents(spark.read.parquet(f"{tmp_path}/files").limit(0)).count() == 0


# --- images and audio ---

def test_image_headers(spark, tmp_path):
    jpeg = (b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc0\x00\x0b\x08" + struct.pack(">HHB", 16, 20, 3) + b"\0\0\0")
    heads = {
        "a.jpg": (jpeg, (20, 16, "RGB")),
        "b.png": (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">IIBB", 3, 4, 8, 6), (3, 4, "RGBA")),
        "c.gif": (b"GIF89a" + struct.pack("<HH", 5, 6), (5, 6, "P")),
        "d.bmp": (b"BM" + b"\0" * 16 + struct.pack("<iiHH", 7, -8, 1, 24), (7, 8, "RGB")),
        "e.webp": (b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0\x10\0\0\0\x09\0\0\x0b\0\0", (10, 12, "RGBA")),
        "f.tiff": (b"II*\0\x08\0\0\0" + struct.pack("<H", 3) + struct.pack("<HHII", 256, 3, 1, 9)
                   + struct.pack("<HHII", 257, 4, 1, 11) + struct.pack("<HHII", 277, 3, 1, 3), (9, 11, "RGB")),
        "g.png": (b"not an image", (0, 0, "unknown")),
        "h.jpeg": (b"\xff\xd8\xff", (0, 0, "unknown")),
    }
    (tmp_path / "cats").mkdir()
    for name, (blob, _) in heads.items():
        (tmp_path / "cats" / name).write_bytes(blob)
    (tmp_path / "cats" / "note.txt").write_text("x")
    df = images.read_images(spark, str(tmp_path))
    assert df.columns == ["image_path", "label", "width", "height", "mode", "filename"]
    got = {r.filename: (r.width, r.height, r.mode) for r in df.collect()}
    assert got == {n: want for n, (_, want) in heads.items() if not n.endswith(".gif")}
    assert {r.label for r in df.collect()} == {"cats"}
    assert "label" not in images.read_images(spark, str(tmp_path), label_from_dir=False).columns


def _tone(path, hz, rate=22050, seconds=0.1, channels=1):
    t = np.arange(int(rate * seconds)) / rate
    y = (np.sin(2 * np.pi * hz * t) * 30000).astype("<i2")
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.repeat(y, channels).tobytes())


def test_audio_folder(spark, tmp_path):
    for label, hz in (("speech", 440), ("music", 880)):
        (tmp_path / label).mkdir()
        for i in range(3):
            _tone(tmp_path / label / f"{i}.wav", hz)
    (tmp_path / "music" / "x.mp3").write_bytes(b"??")
    df = audio.read_audio(spark, str(tmp_path), n_mfcc=20)
    assert len([c for c in df.columns if c.startswith("mfcc_")]) == 20
    got = {(r.label, r.filename): r for r in df.collect()}
    assert len(got) == 7 and np.isnan(got["music", "x.mp3"].mfcc_0)
    assert got["music", "0.wav"].mfcc_1 == pytest.approx(got["music", "1.wav"].mfcc_1)
    assert abs(got["music", "0.wav"].mfcc_1 - got["speech", "0.wav"].mfcc_1) > 1


def test_mel_bank_and_mfcc_properties(tmp_path):
    bank, basis = audio.mel_bank(22050), audio.dct_rows(13)
    assert bank.shape == (128, 1025) and (bank >= 0).all()
    assert np.allclose(basis @ basis.T, np.eye(13), atol=1e-9)
    tone = np.sin(2 * np.pi * 1000 * np.arange(22050) / 22050)
    loud, quiet = audio.mean_mfcc(tone, bank, basis), audio.mean_mfcc(tone / 10, bank, basis)
    # A tenth of the amplitude is -20 dB in every band: only the first coefficient moves.
    assert loud[0] - quiet[0] == pytest.approx(20 * np.sqrt(128), rel=1e-3)
    assert np.allclose(loud[1:], quiet[1:], atol=1e-6)


def test_stereo_and_resampling(tmp_path):
    _tone(tmp_path / "s.wav", 440, rate=44100, channels=2, seconds=0.5)
    samples, rate = audio.wav_samples((tmp_path / "s.wav").read_bytes())
    assert samples.shape == (22050, 2) and rate == 44100
    down = audio.resample(audio.mono(samples), rate, 22050)
    t = np.arange(len(down)) / 22050
    assert np.abs(down - np.sin(2 * np.pi * 440 * t) * 30000 / 32768)[50:-50].max() < 0.05


def test_mixed_files_of_one_glob_lose_nothing(spark, tmp_path):
    (tmp_path / "x" / "sub").mkdir(parents=True)
    (tmp_path / "x" / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "x" / "b.csv").write_text('b;a;c\n"z\ny";3;9\n')
    (tmp_path / "x" / "sub" / "c.csv").write_text("a,b\n5,6\n")
    got = files.read_table(spark, f"{tmp_path}/x/*.csv")
    assert sorted(map(repr, got.select("a", "b", "c").collect())) == ["Row(a=1, b='2', c=None)", "Row(a=3, b='z\\ny', c=9)"]
    assert files.read_table(spark, f"{tmp_path}/x/**/*.csv").count() == 3
    assert files.read_table(spark, f"{tmp_path}/**/sub/*.csv").first().asDict() == {"a": 5, "b": 6}
    typed = files.read_csv(spark, f"{tmp_path}/x/*.csv", schema="c int, a int")
    assert sorted(map(tuple, typed.collect()), key=repr) == [(9, 3), (None, 1)]
    with pytest.raises(FileNotFoundError):
        files.read_table(spark, f"{tmp_path}/**/none/*.csv")


def test_json_layout_of_each_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"k": 1},\n{"k": 2}]')
    (tmp_path / "b.json").write_text('\n{"k": 3}\n{"k": 4, "z": "q"}\n')
    (tmp_path / "c.json").write_text('{\n"k": 5}')
    got = files.read_json(spark, f"{tmp_path}/*.json")
    assert sorted(r.k for r in got.collect()) == [1, 2, 3, 4, 5] and "z" in got.columns


def test_parquet_schemas_that_do_not_merge(spark, tmp_path):
    spark.sql("SELECT 1 AS a").write.parquet(f"{tmp_path}/p/one")
    spark.sql("SELECT 'x' AS a, 2 AS b").write.parquet(f"{tmp_path}/p/two")
    got = files.read_parquet(spark, f"{tmp_path}/p/*")
    assert sorted(map(tuple, got.collect()), key=repr) == [("1", None), ("x", 2)]


@pytest.mark.parametrize("text, n", [
    ('{"x": NaN, "y": 1}\n{"x": 2.5, "y": 2}\n{"x": 3.5, "y": 3}\n', 3),
    ("{'x': 1.5, 'y': 1}\n{'x': 2.5, 'y': 2}\n{'x': 'it]s', 'y': 3}\n", 3),
    ('[{"x": 1.5, "y": 1}]\n[{"x": 2.5, "y": 2}, {"x": 3.5, "y": 3}]\n[{"x": 4.5, "y": 4}]\n', 4),
    ('{"x": "[{\\\\\\"", "y": 1}\n{"x": "b", "y": 2}\n{"x": "}]", "y": 3}\n', 3),
    ('{"x": "cut of\n{"x": "b", "y": 2}\n{"x": "c", "y": 3}\n', 3),
    ("[\n {'x': NaN, 'y': 1},\n {'x': '[', 'y': 2}]\n\n", 2),
])
def test_json_layout_does_not_hang_on_the_first_line(spark, tmp_path, text, n):
    (tmp_path / "t.json").write_text(text)
    got = files.read_json(spark, str(tmp_path / "t.json"))
    assert got.count() == n and {"x", "y"} <= set(got.columns)
    assert files.read_json(spark, str(tmp_path / "t.json"), schema="x string, y int").count() == n


def test_repeated_key_in_the_first_line(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"x": 1, "x": 2}\n{"x": 3}\n{"x": 4}\n')
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    try:
        for setting in (False, True):
            spark.conf.set("spark.sql.variant.allowDuplicateKeys", setting)
            assert files.read_json(spark, str(tmp_path / "t.json"), schema="x int").count() == 3
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", before)


def test_several_json_values_over_lines_are_an_error(spark, tmp_path):
    (tmp_path / "t.json").write_text('{\n"k": 1\n}\n{\n"k": 2\n}\n')
    with pytest.raises(ValueError, match="several JSON values"):
        files.read_json(spark, str(tmp_path / "t.json"))
    assert files.read_json(spark, str(tmp_path / "t.json"), multi_line=True).count() == 1


def _folders(root, kind):
    """Three files whose column r is only in the path; one file is of another kind."""
    texts = {"csv": ["a,b\n1,2\n", "b;a\n3;4\n", "a,b\n5,6\n"],
             "json": ['{"a": 1, "b": 2}\n', '[\n{"a": 4, "b": 3}\n]\n', '{"a": 5, "b": 6}\n']}[kind]
    for r, text in zip(["EU", "US", "a%3Ab"], texts):
        (root / f"r={r}").mkdir(parents=True)
        (root / f"r={r}" / f"x.{kind}").write_text(text)
    return [(1, 2, "EU"), (4, 3, "US"), (5, 6, "a:b")]


@pytest.mark.parametrize("kind", ["csv", "json"])
@pytest.mark.parametrize("path", ["", "/*/*.{}", "/r=*", "/**/*.{}"])
def test_path_columns_of_mixed_files(spark, tmp_path, kind, path):
    want = _folders(tmp_path / "part", kind)
    read = files.read_csv if kind == "csv" else files.read_json
    path = f"{tmp_path}/part{path.format(kind)}"
    assert rows(read(spark, path).select("a", "b", "r")) == want
    assert rows(read(spark, path, schema="a int, b int, r string").select("a", "b", "r")) == want


def test_path_columns_with_a_given_json_layout(spark, tmp_path):
    for r in ("EU", "US"):
        (tmp_path / "part" / f"r={r}").mkdir(parents=True)
        (tmp_path / "part" / f"r={r}" / "x.json").write_text('{"a": 1}\n')
    for path in ("part", "part/*", "part/**/*.json"):
        assert rows(files.read_json(spark, f"{tmp_path}/{path}", multi_line=False)) == [(1, "EU"), (1, "US")]


def test_path_columns_have_one_type_over_all_files(spark, tmp_path):
    for r, text in {"n=1/d=2024-01-02": "a\n1\n", "n=2/d=x": "b\n2\n", "n=3/d=__HIVE_DEFAULT_PARTITION__": "a\n3\n"}.items():
        (tmp_path / r).mkdir(parents=True)
        (tmp_path / r / "x.csv").write_text(text)
    got = files.read_csv(spark, str(tmp_path)).select("a", "b", "n", "d")
    assert dict(got.dtypes)["n"] == "int" and dict(got.dtypes)["d"] == "string"
    assert rows(got) == sorted([(1, None, 1, "2024-01-02"), (None, 2, 2, "x"), (3, None, 3, None)], key=repr)


def test_path_columns_of_parquet_that_does_not_merge(spark, tmp_path):
    spark.sql("SELECT 1 AS a").write.parquet(f"{tmp_path}/p/r=EU")
    spark.sql("SELECT 'x' AS a").write.parquet(f"{tmp_path}/p/r=US")
    for path in ("p", "p/*", "p/**/*.parquet"):
        assert rows(files.read_parquet(spark, f"{tmp_path}/{path}").select("a", "r")) == [("1", "EU"), ("x", "US")]
    spark.sql("SELECT 2 AS a").write.parquet(f"{tmp_path}/q/r=EU")
    assert rows(files.read_parquet(spark, f"{tmp_path}/q/**/*.parquet")) == [(2, "EU")]
    assert rows(files.read_parquet(spark, f"{tmp_path}/q/r=EU")) == [(2,)]


def _jobs(spark, name, run):
    """Spark jobs that a call starts on the driver."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return len(context.statusTracker().getJobIdsForGroup(name))


def test_parquet_kinds_take_jobs_by_schema_not_by_file(spark, tmp_path):
    kinds = [pa.array([1, 2], pa.int64()), pa.array(["x", "y"]), pa.array([[1.5], None])]

    def write(folder, n):
        (tmp_path / folder).mkdir()
        for i in range(n):
            for k, values in enumerate(kinds):
                pq.write_table(pa.table({"a": values, "i": [i, k]}), tmp_path / folder / f"{k}-{i}.parquet")
        return str(tmp_path / folder)

    few, many = write("few", 40), write("many", 160)
    jobs = [_jobs(spark, path, lambda path=path: files.read_parquet(spark, path)) for path in (few, many)]
    assert jobs[0] == jobs[1] < 20
    got = files.read_parquet(spark, many)
    assert got.count() == 960 and dict(got.dtypes)["a"] == "string"
    assert got.where("i < 3").groupBy("a").count().count() == 6


def test_parquet_kinds_with_equal_schemas_are_read_together(spark, tmp_path):
    spark.sql("SELECT 1 AS a, 'p' AS b").write.parquet(f"{tmp_path}/p/one")  # written by Spark, the next by another writer
    (tmp_path / "p" / "two").mkdir()
    pq.write_table(pa.table({"a": pa.array([2], pa.int32()), "b": ["q"]}), tmp_path / "p" / "two" / "x.parquet")
    pq.write_table(pa.table({"a": ["r"]}), tmp_path / "p" / "two" / "y.parquet")
    got = files.read_parquet(spark, f"{tmp_path}/p/*")
    assert sorted(map(tuple, got.collect()), key=repr) == [("1", "p"), ("2", "q"), ("r", None)]


def test_csv_files_said_to_be_alike_need_no_pass(spark, tmp_path):
    for r, text in {"EU": "a;b\n1;x\n", "US": 'a;b\n2;"y;z"\n'}.items():
        (tmp_path / "part" / f"r={r}").mkdir(parents=True)
        (tmp_path / "part" / f"r={r}" / "x.csv").write_text(text)
    for path in ("part", "part/*", "part/**/*.csv"):
        read = lambda **k: files.read_csv(spark, f"{tmp_path}/{path}", alike=True, sep=";", **k)  # noqa: B023, E731
        assert rows(read().select("a", "b", "r")) == [(1, "x", "EU"), (2, "y;z", "US")]
        assert rows(read(schema="b string, z int, a long, r string")) == [("x", None, 1, "EU"), ("y;z", None, 2, "US")]
    # With the columns of the schema in its order, only Spark's own look at the first header is left.
    assert _jobs(spark, "alike", lambda: files.read_csv(spark, f"{tmp_path}/part", alike=True, sep=";", schema="a int, b string")) <= 1
    (tmp_path / "part" / "r=US" / "z.csv").write_text("b;a\nq;3\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, f"{tmp_path}/part", alike=True, sep=";", schema="a int, b string").collect()
    assert files.read_csv(spark, f"{tmp_path}/part", schema="a int, b string").count() == 3


def test_json_with_comments_before_and_after(spark, tmp_path):
    (tmp_path / "t.json").write_text('// [\n{"k": 1}\n{"k": 2}\n/* ] */\n')
    (tmp_path / "u.json").write_text('// head\n[\n{"k": 3}, // {\n{"k": 4}\n]\n// tail\n')
    got = files.read_json(spark, f"{tmp_path}/*.json", allowComments=True)
    assert sorted(r.k for r in got.where("k is not null").collect()) == [1, 2, 3, 4]


def test_files_are_parsed_in_parts_of_bounded_size(spark):
    import pyarrow as pa
    from tabforge.sources import documents as D

    content, suffix = pa.array([b"x" * 1000] * 5000 + [None] + [b"y" * (3 << 20)]), pa.array([".docx"] * 5002)
    found = list(D.parts([(content, suffix), (content.slice(0, 0), suffix.slice(0, 0))]))
    assert max(len(c) for c, _ in found) <= 5002 * D.PART_BYTES // content.nbytes
    assert [v for c, _ in found for v in c.to_pylist()] == content.to_pylist()
    # More rows than a part has, in one batch; each keeps its own result.
    words = spark.range(900).coalesce(1).selectExpr("id", "concat('file:/d/', id, '.docx') AS path", "repeat(concat(id, ' '), 1000) AS text")
    from tabforge.registered.messages import docx_bytes
    got = D.parse_documents(words.select("path", docx_bytes("text").alias("content"))).collect()
    assert {r.filename: r.text for r in got} == {f"{i}.docx": " ".join([str(i)] * 1000) for i in range(900)}


def test_a_saved_version_has_files_by_its_rows(spark, sf_dir, monkeypatch):
    from tabforge.registered import versions as V

    monkeypatch.setattr(V, "FILE_ROWS", 500, raising=False)
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    files = [f for f in spark.read.parquet(V.saved_lines(spark, sf_dir)).inputFiles()]
    assert len(files) >= n // 500
