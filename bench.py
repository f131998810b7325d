"""Time registered queries and print one JSON line.

BENCH_SF_DIR picks the data, BENCH_CPUS the cores. Names on the command line pick other queries,
``--all`` runs every one. Every column of every row is computed (noop sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

from phonolake.registry import QUERIES
from phonolake.session import local_session

HEADLINE = """
clean_text chunk_words dedup_exact filter_language word_frequencies vocab_wordlevel build_lexicon
phonetize_words transliterate_ipa prepare_wikitext clean_corpus encode_single mlm_mask encode_pair
train_val_test_split cap_splits oversample_classes rhyme_positive_pairs build_rhyme_pairs
vocab_bpe near_spelling_pairs sample_unrelated_pairs build_etymology_task build_meter_task
metric_spearman metric_roc_auc metric_hit_at_k score_predictions random_baseline build_bilingual_mlm
""".split()


def run(spark, name: str, folder: str) -> float:
    start = time.time()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = list(QUERIES) if "--all" in sys.argv else [a for a in sys.argv[1:] if a in QUERIES] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    run(spark, "text_hash", folder)  # start the session and its Python workers outside the timing
    times: dict[str, float] = {}
    for name in names:
        try:
            times[name] = run(spark, name, folder)
        except Exception as error:  # noqa: BLE001 - one failure must not hide the other timings
            print(f"{name}: {error}", file=sys.stderr)
        if "-v" in sys.argv:
            print(name, times.get(name), file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
