import __spark_entry__ as E
from sitesift.llm import catalog

NAMES = {"op1_suffixes", "op2_mixing", "op3_maintext", "op4_topk", "op5_pii", "op6_sharding", "op7_quality",
         "op8_decontaminate", "op9_simhash", "op10_toxicity", "op11_neighbours", "op12_lexical", "op13_repair"}


def test_every_operator_is_registered():
    assert set(catalog.QUERIES) == NAMES and {*NAMES, "pipeline"} <= set(E.queries())
    assert set(catalog.ORACLE) == {"op2_mixing", "op4_topk", "op12_lexical", "op13_repair"} and set(catalog.ORACLE) <= set(E.oracle_sql())
