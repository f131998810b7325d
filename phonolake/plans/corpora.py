"""Corpus preparation jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.functions import text as X
from phonolake.functions.hashing import hash_unit
from phonolake.operators import cleaning as C
from phonolake.operators import language as L
from phonolake.operators import lexicon as G
from phonolake.operators import sampling as S
from phonolake.operators import vocabulary as V
from phonolake.sources import corpora as D
from phonolake.sources.catalog import task_fields


def prepare_wikitext(
    docs: DataFrame,
    profile: DataFrame | None = None,
    lexicon: DataFrame | None = None,
    chunk_size: int = 100,
    languages: Sequence[str] = ("en", "fr"),
) -> DataFrame:
    """Chunk, clean, deduplicate, keep English, drop empty texts, optionally transcribe.

    ``doc_id`` and ``chunk_no`` name a chunk and define "first" for duplicates.
    """
    key = ["doc_id", "chunk_no"]
    chunked = C.chunk_words(docs.select("doc_id", "text"), chunk_size, index="chunk_no").select(*key, "text")
    out = C.dedup_exact(C.map_text(chunked, X.clean_text), order=key)
    if profile is not None:
        out = L.filter_language(out, profile, "en", languages, id_col=key)
    out = C.filter_nonempty(out)
    if lexicon is not None:
        out = C.filter_nonempty(G.translate_corpus(out, lexicon, id_col=key))
    return out


def prepare_bookcorpus(
    books: DataFrame,
    articles: DataFrame,
    lexicon: DataFrame | None = None,
    chunk_size: int = 100,
    validation: float = 0.01,
    seed: int = 42,
) -> DataFrame:
    """Concatenate, split off validation rows, chunk, drop empty, clean, shuffle.

    The empty filter runs before cleaning, so a cleaned text may be empty. No duplicates are
    removed and no language is filtered here.
    """
    both = C.concat_corpora(books.select("doc_id", "text"), articles.select("doc_id", "text"))
    held_out = hash_unit(f"{seed}:validation", "doc_id") < validation
    split = both.withColumn("split", F.when(held_out, "validation").otherwise("train"))
    chunked = C.filter_nonempty(C.chunk_words(split, chunk_size, index="chunk_no"))
    cleaned = C.map_text(chunked, X.clean_text)
    if lexicon is not None:
        cleaned = G.translate_corpus(cleaned, lexicon, id_col=["doc_id", "chunk_no"])
    return S.seeded_shuffle(cleaned, ["doc_id", "chunk_no"], seed)


def clean_corpus(
    docs: DataFrame, profile: DataFrame, languages: Sequence[str] = ("en", "fr"), id_col: str = "doc_id"
) -> DataFrame:
    """Deduplicate, keep English, clean - in that order, empty results stay."""
    unique = C.dedup_exact(docs, order=id_col)
    return C.map_text(L.filter_language(unique, profile, "en", languages, id_col), X.clean_text)


def build_verse_lines(poems: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lines of poems: length filter on the raw line, then normalization."""
    lines = poems.select(id_col, F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return C.map_text(C.filter_line_length(lines), X.normalize_poem_line)


def build_phoneme_corpus(docs: DataFrame, lexicon: DataFrame, chunk_size: int = 256) -> DataFrame:
    """Texts as space-separated phonemes, in chunks of 256."""
    sounded = G.phonetize_phonemes(docs.select("doc_id", "text"), lexicon)
    return C.filter_nonempty(C.chunk_words(sounded, chunk_size, splitter=X.whitespace_words, index="chunk_no"))


def train_vocabulary(
    corpus: DataFrame,
    kind: str = "WordLevel",
    columns: Sequence[str] = ("text", "original_text"),
    size: int = V.VOCAB_SIZE,
    specials: Sequence[str] = V.SPECIALS,
    extra_tokens: Sequence[str] = (),
    weight: str | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """``(vocab, merges)`` over all splits and both text columns; a row counts ``weight`` times. Merge-based kinds iterate."""
    counts = V.word_frequencies(corpus, columns, weight=weight)
    if kind == "WordLevel":
        return V.vocab_wordlevel(counts, size, specials), None
    if kind == "BPE":
        return V.train_merges(counts, size, specials, extra_tokens=extra_tokens)
    if kind == "WordPiece":
        return V.train_merges(counts, size, specials, prefix="##", extra_tokens=extra_tokens)
    raise ValueError(f"unknown vocabulary kind: {kind}")


def train_phonetic_vocabulary(docs: DataFrame, lexicon: DataFrame, kind: str = "WordLevel", **options) -> tuple[DataFrame, DataFrame | None]:
    """``train_vocabulary`` over the transcription of ``text`` and the text itself.

    No word and no token crosses white space, in either text, so each distinct piece between white space is transcribed
    and split once and counts as often as it occurs.
    """
    pieces = G.translate_corpus(V.spaced_pieces(docs), lexicon, id_col="text")
    return train_vocabulary(pieces, kind, weight="n", **options)


def convert_to_phonetic(spark, root: str, name: str, lexicon: DataFrame) -> str:
    """Read a stored corpus, transcribe it, store it under the phonetic name."""
    corpus = D.load_corpus(spark, D.dataset_dir(root, name))
    return D.write_corpus(G.translate_corpus(corpus, lexicon), D.dataset_dir(root, name, phonetic=True))


def prepare_benchmark_tasks(tasks: dict[str, DataFrame], root: str, lexicon: DataFrame | None = None) -> list[str]:
    """Store every task, transcribed when a lexicon is given; one plan per task."""
    return [
        D.write_task(translate_task_fields(df, task, lexicon) if lexicon is not None else df, root, task, lexicon is not None)
        for task, df in tasks.items()
    ]


def translate_task_fields(df: DataFrame, task: str, lexicon: DataFrame, id_col: str = "idx") -> DataFrame:
    """Transliterate the one or two text fields of a task; an unknown task is an error."""
    return G.transliterate_ipa(df, lexicon, fields=list(task_fields(task)), id_col=id_col)
