"""All registered queries of this subpackage, the pipeline among them."""

import corpus_pipeline
from offerlens.llm.queries import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
