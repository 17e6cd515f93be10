"""Binary and tool-made files, written here and read back."""

import gzip
import sqlite3
import struct
import zipfile

import pytest

from assaylake.operators import tables
from assaylake.sinks import tables as sinks
from assaylake.sources import alignments, files


def record(name, ref, pos, cigar, seq, tags):
    ops = [(int(n), alignments.OPERATIONS.index(o)) for n, o in cigar]
    codes = [alignments.BASES.index(b) for b in seq] + [0] * (len(seq) % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    raw = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(ops), 0, len(seq), -1, -1, 0) + name.encode() + b"\0"
    raw += b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(raw)) + raw


def test_alignments(spark, tmp_path):
    tag = b"XSA+NHC\x01CBZAAC\0UBZTT\0GXZg1\0"
    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 10000)
    body += record("a", 0, 99, [(10, "M"), (500, "N"), (5, "M"), (2, "D"), (3, "M"), (100, "N"), (4, "M")], "ACGTACGTACGTACGTACGTAC", tag)
    body += record("b", 0, 99, [(10, "M"), (500, "N"), (6, "M")], "ACGTACGTACGTACGT", tag) + record("c", -1, -1, [], "ACG", b"")
    with gzip.open(tmp_path / "x.bam", "wb") as f:
        f.write(body)
    (tmp_path / "x.sam").write_text("@HD\tVN:1\n" + "\n".join(["a\t0\tchr1\t100\t60\t10M500N5M2D3M100N4M\t*\t0\t0\tACGTACGTACGTACGTACGTAC\t*\tXS:A:+\tCB:Z:AAC\tUB:Z:TT\tGX:Z:g1", "b\t0\tchr1\t100\t60\t10M500N6M\t*\t0\t0\tACGTACGTACGTACGT\t*\tXS:A:+\tCB:Z:AAC\tUB:Z:TT\tGX:Z:g1", "c\t4\t*\t0\t0\t*\t*\t0\t0\tACG\t*"]) + "\n")
    for t in (files.bam(spark, str(tmp_path / "x.bam")), files.sam(spark, str(tmp_path / "x.sam"))):
        rows = {r.name: r for r in t.collect()}
        assert rows["a"].seq == "ACGTACGTACGTACGTACGTAC" and rows["a"].tags["CB"] == "AAC" and rows["c"].chrom is None
        got = {(r.chrom, r.left, r.right, r.strand): r.reads for r in files.spliced(t).collect()}
        assert got == {("chr1", 109, 610, "+"): 2, ("chr1", 619, 720, "+"): 1}
        m = tables.molecules(files.barcoded(t), "barcode", "tag", "umi").first()
        assert (m.barcode, m.tag, m.reads, m.molecules) == ("AAC", "g1", 2, 1)


def test_reads(spark, tmp_path):
    (tmp_path / "r.fastq").write_text("@r1\nAACCGGTTA\n+\nIIIIIIIII\n@r2\nAAC\n+\nIII\n@r3\nTTGGCCAAT\n+\n@IIIIIIII\n")
    got = sorted((r.barcode, r.umi, r.rest) for r in files.fastq(spark, str(tmp_path / "r.fastq"), 4, 3).collect())
    assert got == [("AACC", "GGT", "TA"), ("TTGG", "CCA", "AT")]


def test_worksheets(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="one" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>gene</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>1.5</v></c><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    got = [(r.sheet, r.row, r.cells) for r in files.worksheets(spark, str(tmp_path / "w.xlsx")).orderBy("row").collect()]
    assert got == [("one", 1, ["gene", None, "ab"]), ("one", 2, ["1.5", "x"])]


def test_moved_and_deleted_sheets(spark, tmp_path):
    ns, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda v: f'<worksheet xmlns="{ns}"><sheetData><row r="1"><c r="A1"><v>{v}</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{r}"><sheets><sheet name="last" sheetId="4" r:id="r9"/><sheet name="chart" sheetId="7" r:id="r3"/><sheet name="first" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r3" Target="chartsheets/sheet1.xml"/><Relationship Id="r9" Target="/xl/worksheets/sheet4.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet(1))
        z.writestr("xl/worksheets/sheet4.xml", sheet(4))
        z.writestr("xl/chartsheets/sheet1.xml", "<chartsheet/>")
    assert sorted((x.sheet, x.cells) for x in files.worksheets(spark, str(tmp_path / "w.xlsx")).collect()) == [("first", ["1"]), ("last", ["4"])]


def test_databases_and_dumps(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.db")
    db.execute("CREATE TABLE t (k TEXT, v REAL)")
    db.executemany("INSERT INTO t VALUES (?, ?)", [("a", 1.0), ("b", None)])
    db.commit()
    db.close()
    got = sorted((r.k, r.v) for r in files.sqlite(spark, str(tmp_path / "a.db"), "SELECT k, v FROM t", "k string, v double").fillna(-1.0).collect())
    assert got == [("a", 1.0), ("b", -1.0)]
    (tmp_path / "gene.txt").write_text('1\tENSG1\t\\N\n2\t"q\t7\n')
    assert [tuple(r) for r in files.dump(spark, str(tmp_path / "gene.txt"), "id int, name string, n int").orderBy("id").collect()] == [(1, "ENSG1", None), (2, '"q', 7)]


def test_tool_outputs(spark, tmp_path):
    for s in "ab":
        (tmp_path / s).mkdir()
        (tmp_path / s / "abundance.tsv").write_text("target_id\tlength\teff_length\test_counts\ttpm\nt1\t10\t9\t3\t1.5\nt1\t10\t9\t1\t0.5\nt2\t10\t9\t0\t0\n")
    got = files.quantified(spark, str(tmp_path / "*/abundance.tsv"), "kallisto").collect()
    assert len(got) == 4 and {(r.feature, r.value) for r in got} == {("t1", 2.0), ("t2", 0.0)}
    (tmp_path / "s.txt").write_text("TYPE\ttext\nFEATURES\tFeatureNum\tProbeName\tgProcessedSignal\nDATA\t1\tp1\t2.0\nDATA\t2\tp1\t4.0\nDATA\t3\tp2\tx\n")
    assert {r.feature: r.value for r in files.scanner(spark, str(tmp_path / "s.txt")).collect()} == {"p1": 3.0, "p2": None}


def test_lists_and_clustered_matrix(spark, tmp_path):
    calls = spark.createDataFrame([("x", "g1", "up"), ("x", "g2", "none"), ("y", "g1", "down")], "comparison string, feature string, call string")
    sinks.write_lists(calls, str(tmp_path / "lists"))
    got = sorted((r.comparison, r.call, r._c0) for r in spark.read.csv(str(tmp_path / "lists"), sep="\t").collect())
    assert got == [("denominator", "all", "g1"), ("denominator", "all", "g2"), ("x", "up", "g1"), ("y", "down", "g1")]
    m = spark.createDataFrame([("g1", 2, 2, "s1", 1.0), ("g1", 2, 2, "s2", 2.0), ("g2", 1, 1, "s2", 3.0)], "feature string, row_cluster int, place int, sample string, value double")
    got = [tuple(r) for r in sinks.clustered(m, [("s2", 1), ("s1", 2)]).collect()]
    assert got == [("column_clusters-flat", "", "1", "2"), ("g2", "1", "3.0", None), ("g1", "2", "2.0", "1.0")]


def test_junction_dialects_with_reads_in_names(spark, tmp_path):
    from assaylake.sources import assays

    bed = "chr1\t100\t300\t{}\t9\t+\t100\t300\t0\t2\t20,30\t0,170\n"
    (tmp_path / "h.bed").write_text('track name="x"\n' + bed.format("j|junc=7") + bed.format("none"))
    (tmp_path / "s.bed").write_text(bed.format("(5)[2_1]") + bed.format("x"))
    for name, dialect, reads in (("h.bed", "hmm", 7.0), ("s.bed", "splicemap", 5.0)):
        got = assays.junctions(spark, str(tmp_path / name), dialect).collect()
        assert [(r.chrom, r.left, r.right, r.strand, r.reads) for r in got] == [("chr1", 120, 271, "+", reads)]
    (tmp_path / "e.tab").write_text("chr2\ts\texon\t10\t90\t12\t-\t.\tg\nchr2\ts\tCDS\t10\t90\t12\t-\t.\tg\n")
    assert [(r.left, r.right, r.reads) for r in assays.junctions(spark, str(tmp_path / "e.tab"), "bioscope_exon").collect()] == [(11, 89, 12.0)]
    c = ["x"] * 22
    c[1], c[2], c[4], c[8], c[17], c[19] = "chr3", "-", "50", "80", "3.0", "2.9"
    (tmp_path / "j.tab").write_text("\t".join(c) + "\n")
    assert [(r.chrom, r.left, r.right, r.strand, r.reads) for r in assays.junctions(spark, str(tmp_path / "j.tab"), "bioscope_junction").collect()] == [("chr3", 50, 80, "-", 5.0)]


def test_cdt_and_chosen_samples(spark, tmp_path):
    from assaylake.sources import tables as sources

    (tmp_path / "x.cdt").write_text("GID\tUNIQID\tNAME\tGWEIGHT\ts1\ts2\nAID\t\t\t\tARRY0X\tARRY1X\nEWEIGHT\t\t\t\t1\t1\nGENE0X\tg1\tg1\t1\t2.5\t\n")
    got = sources.clustered_tree_matrix(spark, str(tmp_path / "x.cdt"))
    assert sorted((r.feature, r["sample"], r.value) for r in got.fillna(-1.0).collect()) == [("GENE0X", "s1", 2.5), ("GENE0X", "s2", -1.0)]
    assert sinks.chosen(got, ["s2", "no", "s1"]).columns == ["feature", "s2", "s1"] and sinks.chosen(got, ["no", "s1"], "include").columns == ["feature", "no", "s1"]
    with pytest.raises(ValueError, match="no samples named no"):
        sinks.chosen(got, ["no", "s1"], "error")
