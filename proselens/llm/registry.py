"""The queries of this subpackage and their DuckDB counterparts."""

import corpus_pipeline

from . import decontam, jaccard, langid, lm, mixing, secrets, shards, suffixes, topk, warc


def queries():
    return {
        "op1_suffix_dedup": suffixes.query,
        "op2_decontamination": decontam.query,
        "op3_warc": warc.query,
        "op4_mixing": mixing.query,
        "op5_lm_scores": lm.query,
        "op6_ring_shards": shards.query,
        "op7_secrets": secrets.query,
        "op8_jaccard_join": jaccard.query,
        "op9_topk": topk.query,
        "op10_langid": langid.query,
        "pipeline": corpus_pipeline.run,
        # what SQL can express of queries that it can't express whole
        "mix_targets": mixing.targets_query,
        "shard_loads": shards.loads_query,
        "secret_counts": secrets.base_query,
    }


def oracle_sql():
    return {"op1_suffix_dedup": suffixes.ORACLE, "op3_warc": warc.ORACLE, "op8_jaccard_join": jaccard.ORACLE, "op9_topk": topk.ORACLE, "mix_targets": mixing.TARGETS, "shard_loads": shards.LOADS, "secret_counts": secrets.BASE}
