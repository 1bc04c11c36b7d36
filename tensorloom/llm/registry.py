"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tensorloom.llm.centroids import OP11_SQL, op11_clusters
from tensorloom.llm.fim import OP12_SQL, op12_fim
from tensorloom.llm.minhash import op9_minhash
from tensorloom.llm.mixing import OP5_SQL, op5_mix
from tensorloom.llm.pitman_yor import op13_model
from tensorloom.llm.quality import op1_quality
from tensorloom.llm.secrets import op6_secrets
from tensorloom.llm.shards import op8_shards
from tensorloom.llm.simhash import op4_simhash
from tensorloom.llm.toxicity import op7_toxicity
from tensorloom.llm.urls import OP2_SQL, op2_urls
from tensorloom.llm.warc import OP3_SQL, op3_warc
from tensorloom.llm.winnow import OP10_SQL, op10_winnow

QUERIES = {
    "op1_quality": op1_quality,
    "op2_urls": op2_urls,
    "op3_warc": op3_warc,
    "op4_simhash": op4_simhash,
    "op5_mix": op5_mix,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_shards": op8_shards,
    "op9_minhash": op9_minhash,
    "op10_winnow": op10_winnow,
    "op11_clusters": op11_clusters,
    "op12_fim": op12_fim,
    "op13_model": op13_model,
}

ORACLES: dict[str, str] = {
    "op2_urls": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op5_mix": OP5_SQL,
    "op10_winnow": OP10_SQL,
    "op11_clusters": OP11_SQL,
    "op12_fim": OP12_SQL,
}
