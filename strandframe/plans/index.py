"""A sequence set with its settings and index tables, kept as a Parquet folder."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.iupac import SequenceError
from strandframe.operators import index, mems, search
from strandframe.sources.sequences import offsets, read_fasta, require_valid, with_headers

ALPHABETS = {0: "iupac", 1: "exact"}


@dataclass
class SequenceIndex:
    """Valid sequences (seq_id, header, seq, len, start) and the match rule.

    k is the length of the k-mers of `kmers` and of the seeds of locate_many, sa_rate how far apart `samples` are;
    neither changes a result.  Tables are built when first asked for, saved with the sequences and read back.
    """

    refs: DataFrame
    alphabet: str = "iupac"
    k: int = 8
    sa_rate: int = 32
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def build(cls, seqs: DataFrame, alphabet: str = "iupac", k: int = 8, sa_rate: int = 32) -> SequenceIndex:
        refs = index.cut(offsets(require_valid(with_headers(seqs))))
        if refs.isEmpty():
            raise SequenceError("no sequences")
        return cls(refs, alphabet, k, sa_rate)

    @classmethod
    def from_fasta(cls, spark: SparkSession, path: str, **settings) -> SequenceIndex:
        """An index of the FASTA files under path; sequences are numbered by file and place in it."""
        records = read_fasta(spark, path).withColumn("one", F.lit(1))
        return cls.build(index.prefix_sum(records, ["path", "record"], "one", "seq_id").select("seq_id", "header", "seq"), **settings)

    def count(self, pattern: str) -> int:
        return search.count(self.refs, pattern, self.alphabet).first()["n"]

    def locate(self, pattern: str) -> DataFrame:
        return search.locate(self.refs, pattern, self.alphabet)

    def locate_positions(self, pattern: str) -> DataFrame:
        return search.positions(self.refs, pattern, self.alphabet)

    def locate_many(self, patterns: DataFrame) -> DataFrame:
        return search.locate_many(self.refs, patterns, self.k, self.alphabet)

    def map_position(self, places: DataFrame) -> DataFrame:
        return search.map_position(self.refs, places)

    def find_mems(self, reads: DataFrame, min_len: int, locate: bool = False, max_hits: int | None = None) -> DataFrame:
        return mems.located(self.refs, reads, min_len, self.alphabet, max_hits) if locate else mems.find_mems(self.refs, reads, min_len, self.alphabet)

    def find_smems(self, reads: DataFrame, min_len: int, locate: bool = False, max_hits: int | None = None) -> DataFrame:
        return mems.located(self.refs, reads, min_len, self.alphabet, max_hits) if locate else mems.find_smems(self.refs, reads, min_len, self.alphabet)

    def text_len(self) -> int:
        return self.refs.agg(F.coalesce(F.sum(F.col("len") + 1), F.lit(0))).first()[0]

    def num_sequences(self) -> int:
        return self.refs.count()

    def boundaries(self) -> DataFrame:
        """(seq_id, start, end): where each sequence stands in the joined text; end is its end mark."""
        return self.refs.select("seq_id", "start", (F.col("start") + F.col("len")).alias("end"))

    def reversed(self) -> SequenceIndex:
        """The same sequences read backwards."""
        return SequenceIndex(self.refs.withColumn("seq", F.reverse("seq")), self.alphabet, self.k, self.sa_rate)

    def _table(self, name: str, made) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = index.cut(made())
        return self.tables[name]

    def text(self) -> DataFrame:
        return self._table("text", lambda: index.text(self.refs.select("seq_id", "seq")))

    def suffix_array(self) -> DataFrame:
        return self._table("suffix_array", lambda: index.suffix_array(self.text()))

    def bwt(self) -> DataFrame:
        return self._table("bwt", lambda: index.bwt(self.text(), self.suffix_array()))

    def lf(self) -> DataFrame:
        return self._table("lf", lambda: index.lf_mapping(self.bwt()))

    def samples(self) -> DataFrame:
        return self._table("samples", lambda: index.sampled(self.suffix_array(), self.text(), self.sa_rate))

    def kmers(self) -> DataFrame:
        """(kmer, lo, hi) of all literal k-mers."""
        return self._table("kmers", lambda: index.kmer_intervals(self.refs.select("seq_id", "seq"), self.suffix_array(), self.k))

    def lookup(self, asked: DataFrame) -> DataFrame:
        """asked (kmer) of k symbols with their intervals of rows."""
        return index.lookup(self.kmers(), asked)

    def resolve(self, rows: DataFrame) -> DataFrame:
        """(row, text_pos) of rows of the suffix array, from the samples."""
        return index.resolve(rows, self.samples(), self.lf())

    def save(self, path: str) -> None:
        """Write the sequences, the settings and the tables built so far."""
        self.refs.write.mode("overwrite").parquet(f"{path}/refs")
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        tag = next(t for t, name in ALPHABETS.items() if name == self.alphabet)
        told = [(tag, self.k, self.sa_rate, sorted(self.tables))]
        self.refs.sparkSession.createDataFrame(told, "alphabet int, k int, sa_rate int, tables array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SequenceIndex:
        meta = spark.read.parquet(f"{path}/meta").first()
        if meta["alphabet"] not in ALPHABETS:
            raise SequenceError(f"unknown alphabet tag {meta['alphabet']}")
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}
        return cls(spark.read.parquet(f"{path}/refs"), ALPHABETS[meta["alphabet"]], meta["k"], meta["sa_rate"], tables)
