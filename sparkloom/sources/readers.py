"""Text formats as DataFrames, and the choice of a reader by file name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.notation import comment_fields
from sparkloom.operators.relational import dense_ids
from sparkloom.schemas import conform, get_schema


@dataclass(frozen=True)
class ReadResult:
    """What a reader gives: the main table, companion tables and facts about the run."""

    primary: DataFrame
    companions: dict[str, DataFrame] = field(default_factory=dict)
    run: dict[str, object] = field(default_factory=dict)


Reader = Callable[..., DataFrame | ReadResult]
_READERS: dict[tuple[str, str | None], Reader] = {}


def register_reader(*suffixes: str, modality: str | None = None) -> Callable[[Reader], Reader]:
    """Decorator: the reader of files with these suffixes."""
    def add(reader: Reader) -> Reader:
        for s in suffixes:
            _READERS[s.lower(), modality] = reader
        return reader

    return add


def find_reader(path: str, modality: str | None = None) -> Reader:
    """The reader with the longest matching suffix; one of the modality is preferred."""
    low = path.lower()
    fits = sorted(((len(s), m == modality, (s, m)) for s, m in _READERS if low.endswith(s) and m in (None, modality)), reverse=True)
    if not fits:
        raise ValueError(f"no reader for {path}")
    return _READERS[fits[0][2]]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


@register_reader(".fasta", ".fa", ".fna", ".faa", ".fasta.gz", ".fa.gz")
def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA records: record (header's first word), header, sequence. Records are split by the text source."""
    r = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    text = F.regexp_replace(F.regexp_replace("value", r"^>", ""), "\r", "")
    header = F.substring_index(text, "\n", 1)
    seq = F.when(F.instr(text, "\n") > 0, F.regexp_replace(F.substr(text, F.length(header) + 2), r"\s+", "")).otherwise("")
    return r.select(F.split(header, r"\s", 2)[0].alias("record"), header.alias("header"), F.upper(seq).alias("sequence"))


def read_genome(spark: SparkSession, path: str) -> ReadResult:
    """Contigs and their sequences from FASTA, with dense ids in order of name."""
    r = dense_ids(read_fasta(spark, path).withColumnRenamed("record", "name"), "name", "contig_id")
    return ReadResult(conform(r.withColumn("length", F.length("sequence")), "contigs"), {"sequences": conform(r, "sequences")})


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts from FASTA."""
    r = dense_ids(read_fasta(spark, path).withColumnRenamed("record", "name"), "name", "transcript_id")
    return conform(r.withColumn("length", F.length("sequence")), "transcripts")


def read_genetic_tools(spark: SparkSession, path: str, *, category: str, sequence_type: str, source: str) -> DataFrame:
    """Named constructs from FASTA, with what they are."""
    return read_fasta(spark, path).select(F.col("record").alias("name"), F.lit(category).alias("category"), F.lit(sequence_type).alias("sequence_type"), F.lit(source).alias("source"), "sequence", F.length("sequence").alias("length"))


def _attributes(text: Column) -> Column:
    return F.str_to_map(F.regexp_replace(text, r";\s*$", ""), F.lit(";"), F.lit("="))


@register_reader(".gff3", ".gff", ".gff3.gz", ".gff.gz")
def read_gff3(spark: SparkSession, path: str, contigs: DataFrame | None = None) -> DataFrame:
    """Features of a GFF3 file: 1-based closed positions become 0-based half-open, ID and Parent become numbers, attributes JSON.

    ``contigs`` (name, contig_id) gives the contigs' numbers; without it they are numbered by name.
    """
    c = F.split("value", "\t")
    rows = _lines(spark, path).where(~F.col("value").startswith("#") & (F.size(c) == 9))
    raw = rows.select(c[0].alias("seqid"), c[1].alias("source"), c[2].alias("type"), (c[3].cast("long") - 1).alias("start"), c[4].cast("long").alias("end"), F.expr("try_cast(split(value, '\t')[5] AS DOUBLE)").alias("score"), c[6].alias("strand"), F.expr("try_cast(split(value, '\t')[7] AS INT)").alias("phase"), _attributes(c[8]).alias("a"))
    raw = raw.withColumn("_id", F.coalesce(F.col("a")["ID"], F.concat_ws(":", "seqid", "type", "start", "end", "strand"))).withColumn("_parent", F.split(F.col("a")["Parent"], ",")[0])
    raw = dense_ids(raw, ["seqid", "start", "end", "type", "_id"], "feature_id")
    raw = raw.join(contigs.select(F.col("name").alias("seqid"), "contig_id"), "seqid") if contigs is not None else dense_ids(raw, "seqid", "contig_id")
    parents = raw.groupBy(F.col("_id").alias("_parent")).agg(F.min("feature_id").alias("parent_id"))
    out = raw.join(parents, "_parent", "left").withColumn("name", F.coalesce(F.col("a")["Name"], F.col("a")["gene_name"], F.col("a")["ID"])).withColumn("attributes_json", F.to_json("a"))
    return conform(out, "features")


@register_reader(".bed", ".bed.gz")
def read_bed(spark: SparkSession, path: str, *, feature_type: str = "region", contigs: DataFrame | None = None) -> DataFrame:
    """Features of a BED file of 3 columns or more; columns from the seventh on become JSON."""
    c = F.split("value", "\t")
    rows = _lines(spark, path).where(~F.col("value").rlike(r"^(#|track\b|browser\b)") & (F.size(c) >= 3))
    extra = ["thickStart", "thickEnd", "itemRgb", "blockCount", "blockSizes", "blockStarts"]
    more = F.to_json(F.struct(*[F.get(c, F.lit(6 + i)).alias(n) for i, n in enumerate(extra)]))
    raw = rows.select(c[0].alias("seqid"), c[1].cast("long").alias("start"), c[2].cast("long").alias("end"), F.get(c, F.lit(3)).alias("name"), F.get(c, F.lit(4)).try_cast("double").alias("score"), F.coalesce(F.get(c, F.lit(5)), F.lit(".")).alias("strand"), F.lit(feature_type).alias("type"), F.when(F.size(c) > 6, more).alias("attributes_json"))
    raw = raw.join(contigs.select(F.col("name").alias("seqid"), "contig_id"), "seqid") if contigs is not None else dense_ids(raw, "seqid", "contig_id")
    return conform(dense_ids(raw, ["contig_id", "start", "end", "name"], "feature_id"), "features")


def _tag(tags: Column, name: str) -> Column:
    hit = F.filter(tags, lambda t: F.substring(t, 1, 2) == name)
    return F.substr(F.try_element_at(hit, F.lit(1)), F.lit(6))


def _sam(spark: SparkSession, path: str) -> DataFrame:
    c = F.split("value", "\t")
    rows = _lines(spark, path).where(~F.col("value").startswith("@") & (F.size(c) >= 11))
    fields = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    return rows.select(*[c[i].alias(f) for i, f in enumerate(fields)], F.slice(c, 12, 1000).alias("tags"))


@register_reader(".sam", ".sam.gz")
def read_sam(spark: SparkSession, path: str, *, acquisition_id: int | None = None) -> DataFrame:
    """Reads of a SAM file, one row per primary record, in byte-range splits of the text source."""
    from sparkloom.functions.sequence import mean_quality

    r = _sam(spark, path).where(F.col("flag").cast("int").bitwiseAND(0x900) == 0)
    qual = F.nullif(F.col("qual"), F.lit("*"))
    return conform(r.select(F.col("qname").alias("read_id"), F.lit(acquisition_id).cast("long").alias("acquisition_id"), F.col("seq").alias("sequence"), qual.alias("quality"), F.coalesce(_tag(F.col("tags"), "qs").try_cast("double"), mean_quality(qual)).alias("mean_quality"), _tag(F.col("tags"), "ch").try_cast("int").alias("channel"), _tag(F.col("tags"), "st").alias("start_time"), _tag(F.col("tags"), "du").try_cast("double").alias("duration"), _tag(F.col("tags"), "RG").alias("read_group"), _tag(F.col("tags"), "dx").try_cast("int").alias("duplex")), "reads")


def read_sam_alignments(spark: SparkSession, path: str, *, acquisition_id: int | None = None, tags: tuple[str, ...] = ("cs", "NM", "AS")) -> ReadResult:
    """Mapped records of a SAM file, secondary and supplementary ones too, and chosen tags in long form."""
    from sparkloom.functions.cigar import reference_length
    from sparkloom.session import cut_lineage

    r = _sam(spark, path).withColumn("flag", F.col("flag").cast("int")).where(F.col("flag").bitwiseAND(4) == 0)
    r = cut_lineage(dense_ids(r.withColumn("pos", F.col("pos").cast("long") - 1), ["rname", "pos", "qname", "flag", "cigar"], "alignment_id"))
    bit = lambda b: F.col("flag").bitwiseAND(b) != 0
    a = r.select("alignment_id", F.col("qname").alias("read_id"), F.lit(acquisition_id).cast("long").alias("acquisition_id"), F.col("rname").alias("ref_name"), F.col("pos").alias("ref_start"), (F.col("pos") + reference_length("cigar")).alias("ref_end"), F.when(bit(16), "-").otherwise("+").alias("strand"), F.col("mapq").cast("int").alias("mapq"), "flag", "cigar", bit(256).alias("is_secondary"), bit(2048).alias("is_supplementary"))
    t = r.select("alignment_id", F.explode("tags").alias("t")).select("alignment_id", F.substring("t", 1, 2).alias("tag"), F.substring("t", 4, 1).alias("type"), F.substr("t", F.lit(6)).alias("value")).where(F.col("tag").isin(*tags))
    return ReadResult(conform(a, "alignments"), {"tags": conform(t, "alignment_tags")}, {"source": path})


def read_hits(spark: SparkSession, path: str, *, aligned_to: str | None = None) -> DataFrame:
    """Headerless table of alignment hits, positions 1-based and closed, as they are."""
    s = get_schema("alignment_hits")
    file = type(s)(s.fields[:-1])
    return conform(spark.read.schema(file).option("sep", "\t").csv(path).withColumn("aligned_to", F.lit(aligned_to).cast("string")), "alignment_hits")


def read_counts(spark: SparkSession, path: str, *, ids: tuple[str, ...] = ("protein_id", "sequence"), long_columns: tuple[str, str] = ("sample", "count")) -> DataFrame:
    """Counts in long form, from a wide TSV (a column per sample, an unnamed index column is dropped) or a long parquet table."""
    from sparkloom.operators.aggregates import unpivot_counts

    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        if set(long_columns) <= set(df.columns):
            return df
    else:
        df = spark.read.option("sep", "\t").option("header", True).csv(path)
    df = df.drop(*[c for c in df.columns if c.startswith("_c") or c.startswith("Unnamed") or not c])
    keys = [c for c in df.columns if c in ids]
    return unpivot_counts(df, keys, [c for c in df.columns if c not in keys])


def read_maxquant(spark: SparkSession, path: str, acquisitions: DataFrame | None = None, *, fixed: dict[str, str] | None = None) -> DataFrame:
    """PSMs of ``msms.txt`` in a folder or its ``txt`` folder. Modified sequences are parsed once for each different text."""
    from sparkloom.functions.notation import maxquant_to_proforma

    folder = Path(path)
    file = folder / "msms.txt" if (folder / "msms.txt").exists() else folder / "txt" / "msms.txt"
    df = spark.read.option("sep", "\t").option("header", True).csv(str(file))
    texts = df.select("Modified sequence").distinct().withColumn("modified_sequence", maxquant_to_proforma("Modified sequence", fixed=fixed))
    j = df.join(texts, "Modified sequence")
    if acquisitions is not None:
        j = j.join(acquisitions.select(F.regexp_replace("source_file", r"\.\w+$", "").alias("Raw file"), "acquisition_id"), "Raw file")
    else:
        j = j.withColumn("acquisition_id", F.lit(0))
    number = lambda c, t: F.expr(f"try_cast(`{c}` AS {t})")
    rt = number("Retention time", "double") * 60 if "Retention time" in df.columns else F.lit(None)
    out = j.select(number("id", "bigint").alias("psm_id"), F.col("acquisition_id").cast("long").alias("acquisition_id"), number("Scan number", "int").alias("scan"), "modified_sequence", number("Charge", "int").alias("charge"), rt.alias("rt"), number("Score", "double").alias("score"), number("PEP", "double").alias("qvalue"), (F.coalesce(F.col("Reverse"), F.lit("")) == "+").alias("is_decoy") if "Reverse" in df.columns else F.lit(False).alias("is_decoy"))
    return conform(out, "psms")


def read_parameters(spark: SparkSession, path: str) -> dict[str, str]:
    """Key and value of a parameter file, all of them; it is read line by line."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return {r[0]: r[1] for r in rows.toLocalIterator()}


@register_reader(".msp")
def read_msp(spark: SparkSession, path: str) -> ReadResult:
    """Spectra of an MSP library: name, mw, comment fields; and peaks: name, mz, intensity, annotation. Blocks are split by the text source."""
    b = spark.read.option("lineSep", "\n\n").text(path).select(F.trim(F.regexp_replace("value", "\r", "")).alias("b")).where("b <> ''")
    get = lambda k: F.nullif(F.trim(F.regexp_extract("b", rf"(?mi)^{k}:\s*(.*)$", 1)), F.lit(""))
    spectra = b.select(get("Name").alias("name"), get("MW").cast("double").alias("mw"), comment_fields(F.coalesce(get("Comments?"), F.lit(""))).alias("comment"), "b")
    lines = F.filter(F.split("b", "\n"), lambda x: x.rlike(r"^\s*\d"))
    peaks = spectra.select("name", F.explode(lines).alias("l"))
    f = F.split(F.trim("l"), r"\s+", 3)
    peaks = peaks.select("name", f[0].cast("double").alias("mz"), f[1].cast("double").alias("intensity"), F.nullif(F.regexp_extract("l", r'"([^"]*)"', 1), F.lit("")).alias("annotation"))
    return ReadResult(spectra.drop("b"), {"peaks": peaks}, {"source": path})


def read_taxdump(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """nodes, names and merged of an unpacked taxonomy dump (fields separated by tab, bar, tab)."""
    def dump(name: str) -> DataFrame:
        return _lines(spark, f"{folder}/{name}.dmp").select(F.split(F.regexp_replace("value", r"\t\|$", ""), "\t\\|\t").alias("f"))

    names_ = dump("names").select(F.col("f")[0].cast("long").alias("taxid"), F.col("f")[1].alias("name"), F.lower(F.col("f")[1]).alias("name_lower"), F.col("f")[3].alias("name_class"), F.nullif(F.col("f")[2], F.lit("")).alias("unique_name"))
    nodes = dump("nodes").select(F.col("f")[0].cast("long").alias("taxid"), F.col("f")[1].cast("long").alias("parent_taxid"), F.col("f")[2].alias("rank"), F.col("f")[4].try_cast("short").alias("division_id"), F.col("f")[6].try_cast("short").alias("genetic_code_id"), F.col("f")[8].try_cast("short").alias("mito_genetic_code_id"))
    best = names_.where("name_class = 'scientific name'").groupBy("taxid").agg(F.min("name").alias("scientific_name"))
    merged = dump("merged").select(F.col("f")[0].cast("long").alias("old_taxid"), F.col("f")[1].cast("long").alias("new_taxid"))
    return {"nodes": conform(nodes.join(best, "taxid"), "taxonomy_nodes"), "names": conform(names_, "taxonomy_names"), "merged": conform(merged, "taxonomy_merged")}


def read_species(spark: SparkSession, path: str, *, release: str, source: str, division: str | None = None) -> DataFrame:
    """Species table (TSV with ``#name species taxonomy_id assembly ...``) as catalog rows."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    df = df.toDF(*[c.lstrip("#") for c in df.columns])
    get = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.select(F.lit(source).alias("source"), F.lit(release).alias("release"), get("taxonomy_id").try_cast("long").alias("taxid"), get("name").alias("species_name"), get("species").alias("organism_slug"), get("assembly_accession").alias("assembly_accession"), get("assembly").alias("assembly_name"), F.coalesce(F.lit(division).cast("string"), get("division")).alias("division"))


def read_assembly_summary(spark: SparkSession, path: str) -> DataFrame:
    """Assembly summary with a commented header line as catalog rows."""
    lines = _lines(spark, path)
    head = next((r["value"] for r in lines.where(F.col("value").startswith("#") & F.col("value").contains("\t")).limit(1).collect()), None)
    if head is None:
        raise ValueError("no header line")
    at = {n.strip(): i for i, n in enumerate(head.lstrip("# ").split("\t"))}
    f = F.split("value", "\t")
    get = lambda n: F.nullif(F.get(f, F.lit(at[n])), F.lit("na")) if n in at else F.lit(None).cast("string")
    return lines.where(~F.col("value").startswith("#")).select(get("assembly_accession").alias("assembly_accession"), get("taxid").try_cast("long").alias("taxid"), get("organism_name").alias("species_name"), get("asm_name").alias("assembly_name"), get("assembly_level").alias("assembly_level"), get("refseq_category").alias("refseq_category"), get("ftp_path").alias("fasta_url"))


def read_index_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a README table of proteomes: identifier, taxonomy number, code and species."""
    p = r"^(UP\d+)\s+(\d+)\s+(\S+)\s+(\S+)\s+\d+\s+\d+\s+\d+\s+(.*)$"
    g = lambda i: F.regexp_extract("value", p, i)
    return _lines(spark, path).where(F.col("value").rlike(p)).select(g(1).alias("assembly_accession"), g(2).cast("long").alias("taxid"), g(3).alias("organism_slug"), g(4).alias("division"), g(5).alias("species_name"))


def gene_map(spark: SparkSession, path: str) -> DataFrame:
    """protein to gene from an annotation file: GFF attributes ``protein_id`` and ``gene``, or qualifiers of a flat file."""
    lines = _lines(spark, path)
    if path.endswith((".gbff", ".gb", ".gbk")):
        rows = spark.read.option("lineSep", "     CDS  ").text(path)
        return rows.select(F.regexp_extract("value", r'/protein_id="([^"]+)"', 1).alias("protein_id"), F.regexp_extract("value", r'/gene="([^"]+)"', 1).alias("gene")).where("protein_id <> '' AND gene <> ''").distinct()
    a = _attributes(F.split("value", "\t")[8])
    return lines.where(~F.col("value").startswith("#") & (F.size(F.split("value", "\t")) == 9)).select(F.coalesce(a["protein_id"], F.regexp_replace(a["ID"], "^cds-", "")).alias("protein_id"), a["gene"].alias("gene")).dropna().distinct()
