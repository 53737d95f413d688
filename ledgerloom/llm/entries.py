"""The queries of this package and the DuckDB SQL that checks them."""

from __future__ import annotations

from ledgerloom.llm.grouped_packing import op8_grouped_packing
from ledgerloom.llm.hybrid_search import op12_hybrid_search
from ledgerloom.llm.language_mixture import op6_language_mixture
from ledgerloom.llm.license_rules import op4_license_rules
from ledgerloom.llm.merkle_manifest import op11_merkle_manifest
from ledgerloom.llm.oracles import ORACLES
from ledgerloom.llm.postings_index import op1_benchmark_postings
from ledgerloom.llm.quality_divergence import op7_quality_divergence
from ledgerloom.llm.secret_novelty import op9_secret_novelty
from ledgerloom.llm.slot_sharding import op3_slot_sharding
from ledgerloom.llm.source_mixing import op13_source_mix
from ledgerloom.llm.token_files import op10_token_files
from ledgerloom.llm.vantage_simhash import op5_vantage_simhash
from ledgerloom.llm.warc_writer import op2_warc_archives

QUERIES = {f.__name__: f for f in (op1_benchmark_postings, op2_warc_archives, op3_slot_sharding, op4_license_rules, op5_vantage_simhash, op6_language_mixture, op7_quality_divergence, op8_grouped_packing, op9_secret_novelty, op10_token_files, op11_merkle_manifest, op12_hybrid_search, op13_source_mix)}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
