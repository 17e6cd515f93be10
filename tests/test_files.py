"""Sources and sinks on small files written by the tests."""

from pyspark.sql import functions as F

from assaylake.operators import network
from assaylake.sinks import tables as sinks
from assaylake.sources import assays, knowledge, tables


def put(folder, name, text):
    path = folder / name
    path.write_text(text, newline="")
    return f"file://{path}"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_matrix(spark, tmp_path):
    m = tables.matrix(spark, put(tmp_path, "m.txt", '#c\n!d\nUID\ts1\ts2\n"ENSG01.4"\t1.5\tNA\nb\t\t-2\n'))
    assert rows(m, "feature", "sample") == [("ENSG01", "s1", 1.5), ("ENSG01", "s2", None), ("b", "s1", None), ("b", "s2", -2.0)]
    assert tables.matrix(spark, put(tmp_path, "none.txt", "#only\n")).count() == 0


def test_clustered_matrix(spark, tmp_path):
    m = tables.clustered_matrix(spark, put(tmp_path, "c.txt", "UID\trow_clusters-flat\ts1\ts2\ncolumn_clusters-flat\t\t1\t2\ng\t3\t0.5\t1\n"))
    assert rows(m, "sample") == [("g", "s1", 3, 1, 0.5), ("g", "s2", 3, 2, 1.0)]


def test_junction_dialects(spark, tmp_path):
    bed = put(tmp_path, "a.bed", "track name=x\nchr1\t100\t300\tj\t7\t+\t100\t300\t0\t2\t20,30\t0,170\nchr1\tbad\t3\tj\t7\t+\t1\t3\t0\t2\t1,1\t0,1\n")
    assert [tuple(r)[:5] for r in assays.junctions(spark, bed, "bed12").collect()] == [("chr1", 120, 271, "+", 7.0)]
    star = put(tmp_path, "SJ.out.tab", "chr1\t121\t270\t2\t1\t1\t5\t2\t30\nchr1\t5\t9\t1\t1\t1\t1\t0\t9\n")
    assert [tuple(r)[:5] for r in assays.junctions(spark, star, "star", 4).collect()] == [("chr1", 120, 271, "-", 7.0)]
    tcga = put(tmp_path, "t.txt", "junction\traw\nchr1:120:+,chr1:271:+\t7\n")
    assert [tuple(r)[:5] for r in assays.junctions(spark, tcga, "tcga").collect()] == [("chr1", 120, 271, "+", 7.0)]


def test_sparse_counts(spark, tmp_path):
    m = put(tmp_path, "matrix.mtx", "%%MatrixMarket matrix coordinate integer general\n%\n2 2 2\n1 1 5\n2 2 2\n")
    x = assays.sparse_counts(spark, m, put(tmp_path, "f.tsv", "g1\tA\ng2\tB\n"), put(tmp_path, "b.tsv", "c1\nc2\n"))
    assert rows(x, "feature") == [("g1", "c1", 5.0), ("g2", "c2", 2.0)]


def test_features(spark, tmp_path):
    g = assays.features(spark, put(tmp_path, "x.gff", '#h\nchr1\tm\texon\t5\t9\t.\t-\t.\tID=e1;Parent=t1;ID=e2\nchr1\tm\texon\t7\t9\t2\t+\t.\tgene_id "g 1"; tag "b";\n'))
    got = g.orderBy("start").collect()
    assert (got[0]["attributes"], got[1]["attributes"], got[1]["score"]) == ({"ID": "e1", "Parent": "t1"}, {"gene_id": "g 1", "tag": "b"}, 2.0)


def test_groups_with_bare_returns(spark, tmp_path):
    assert rows(assays.groups(spark, put(tmp_path, "groups.txt", "a\t1\tx\rb\t2\ty"), "\r"), "sample") == [("a", 1, "x"), ("b", 2, "y")]


def test_ontology_and_closure(spark, tmp_path):
    t = knowledge.ontology(spark, put(tmp_path, "x.obo", "format-version: 1\n\n[Term]\nid: GO:1\nname: root\n\n[Term]\nid: GO:2\nname: mid\nis_a: GO:1 ! root\n\n[Term]\nid: GO:3\nname: leaf\nis_a: GO:2 ! mid\nis_a: GO:1\n\n[Typedef]\nid: part_of\n"))
    assert rows(network.closure(knowledge.parents(t)), "child", "ancestor") == [("GO:2", "GO:1"), ("GO:3", "GO:1"), ("GO:3", "GO:2")]


def test_sets_and_interactions(spark, tmp_path):
    assert rows(knowledge.gene_sets(spark, put(tmp_path, "s.txt", "gene\tid\na\t42\na\t42\n")), "element") == [("a", "GO:0000042")]
    assert rows(knowledge.gmt(spark, put(tmp_path, "s.gmt", "s\td\ta\tb\n")), "element") == [("a", "s"), ("b", "s")]
    assert rows(knowledge.interactions(spark, put(tmp_path, "n.sif", "a\tpp\tb\tc\r\n")), "b") == [("a", "pp", "b"), ("a", "pp", "c")]
    gpml = put(tmp_path, "p.gpml", '<Pathway><DataNode TextLabel="TP53"><Xref Database="Ensembl" ID="E1"/></DataNode></Pathway>')
    assert [tuple(r)[1:] for r in knowledge.pathway_nodes(spark, gpml).collect()] == [("TP53", "E1", "Ensembl")]


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([("g1", "b", 1.0), ("g1", "a", 0.0), ("g2", "a", 3.0)], "feature string, sample string, value double")
    assert rows(sinks.triplets(m), "row") == [(1, 2, 1), (2, 1, 7)]
    sinks.write_matrix(m, ["b", "a"], f"file://{tmp_path}/out")
    assert rows(spark.read.csv(f"file://{tmp_path}/out", sep="\t", header=True), "feature") == [("g1", "1.0", "0.0"), ("g2", None, "3.0")]
    sinks.write_by_comparison(m.withColumn("comparison", F.col("sample")), f"file://{tmp_path}/by")
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"comparison=a", "comparison=b"}
