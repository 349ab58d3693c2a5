"""Corpus registries: which documents belong to a named corpus, and what a file is when no registry knows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velith.functions.answers import filled

# Public statutes (slug in the publisher's address, abbreviation, title, category) and papers.
PUBLISHER = "https://www.gesetze-im-internet.de"
GERMAN_LABOUR_LAW = [
    ("kschg", "KSchG", "Kündigungsschutzgesetz", "termination"),
    ("arbzg", "ArbZG", "Arbeitszeitgesetz", "working time"),
    ("burlg", "BUrlG", "Bundesurlaubsgesetz", "leave"),
    ("tzbfg", "TzBfG", "Teilzeit- und Befristungsgesetz", "contracts"),
    ("entgfg", "EntgFG", "Entgeltfortzahlungsgesetz", "pay"),
    ("muschg_2018", "MuSchG", "Mutterschutzgesetz", "parental"),
    ("beeg", "BEEG", "Bundeselterngeld- und Elternzeitgesetz", "parental"),
    ("agg", "AGG", "Allgemeines Gleichbehandlungsgesetz", "equal treatment"),
    ("betrvg", "BetrVG", "Betriebsverfassungsgesetz", "works councils"),
    ("arbschg", "ArbSchG", "Arbeitsschutzgesetz", "health and safety"),
    ("milog", "MiLoG", "Mindestlohngesetz", "pay"),
    ("nachwg", "NachwG", "Nachweisgesetz", "contracts"),
    ("bbig_2005", "BBiG", "Berufsbildungsgesetz", "training"),
    ("jarbschg", "JArbSchG", "Jugendarbeitsschutzgesetz", "health and safety"),
    ("pflegezg", "PflegeZG", "Pflegezeitgesetz", "leave"),
    ("fpfzg", "FPfZG", "Familienpflegezeitgesetz", "leave"),
    ("arbnerfg", "ArbnErfG", "Gesetz über Arbeitnehmererfindungen", "IP"),
    ("a_g", "AÜG", "Arbeitnehmerüberlassungsgesetz", "agency work"),
    ("tvg", "TVG", "Tarifvertragsgesetz", "collective agreements"),
    ("arbgg", "ArbGG", "Arbeitsgerichtsgesetz", "procedure"),
    ("betravg", "BetrAVG", "Betriebsrentengesetz", "pensions"),
    ("bdsg_2018", "BDSG", "Bundesdatenschutzgesetz", "data protection"),
    ("schwarzarbg_2004", "SchwarzArbG", "Schwarzarbeitsbekämpfungsgesetz", "compliance"),
    ("bpersvg_2021", "BPersVG", "Bundespersonalvertretungsgesetz", "works councils"),
    ("arbplschg", "ArbPlSchG", "Arbeitsplatzschutzgesetz", "job protection"),
    ("geschgehg", "GeschGehG", "Geschäftsgeheimnisgesetz", "confidentiality"),
]
ARXIV_NLP = [
    ("1706.03762", "Attention Is All You Need", "attention.pdf"),
    ("1810.04805", "BERT: Pre-training of Deep Bidirectional Transformers", "bert.pdf"),
    ("2005.11401", "Retrieval-Augmented Generation for Knowledge-Intensive NLP", "rag.pdf"),
    ("2004.04906", "Dense Passage Retrieval for Open-Domain QA", "dpr.pdf"),
    ("2212.03533", "Text Embeddings by Weakly-Supervised Contrastive Pre-training", "e5.pdf"),
]

ENTRY = "doc_id string, title string, url string, filename string, language string, category string"
CORPORA = {
    "german_labour_law": [(code.lower(), title, f"{PUBLISHER}/{slug}/{code}.pdf", f"{code}.pdf", "de", kind) for slug, code, title, kind in GERMAN_LABOUR_LAW],
    "arxiv_nlp": [(f"arxiv_{number}", title, f"https://arxiv.org/pdf/{number}", name, "en", "nlp") for number, title, name in ARXIV_NLP],
}


def corpus(spark: SparkSession, name: str) -> DataFrame:
    """The entries of a named corpus."""
    if name not in CORPORA:
        raise KeyError(f"unknown corpus {name!r}; there are {', '.join(sorted(CORPORA))}")
    return spark.createDataFrame(CORPORA[name], ENTRY)


def described(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Files (filename, ...) with entry columns: matched by file name, else by its stem as id, else made from the name.

    The registry is a fixed list of some dozen rows, so both joins broadcast it.
    """
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    columns = ["doc_id", "title", "url", "language", "category"]
    pick = lambda tag: F.broadcast(entries.select(F.col("filename").alias(f"{tag}_name"), *(F.col(c).alias(f"{tag}_{c}") for c in columns)))
    joined = files.withColumn("stem", stem).join(pick("a"), F.col("filename") == F.col("a_name"), "left").join(pick("b"), F.lower("stem") == F.col("b_doc_id"), "left")
    default = {"doc_id": F.lower("stem"), "title": F.col("stem"), "url": F.lit(""), "language": F.lit("de"), "category": F.lit("uploaded")}
    return joined.select(*(F.coalesce(f"a_{c}", f"b_{c}", default[c]).alias(c) for c in columns), *(F.col(c) for c in files.columns))


def title_of(entry_title: str, own_title: str, doc_id: str):
    """Title with its fallbacks: registry, the file's own, the id."""
    return F.coalesce(filled(entry_title), filled(own_title), F.col(doc_id))
