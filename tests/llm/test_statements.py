"""The DuckDB statements reach the end of long texts and items."""

from tests.test_statements import answer
from tonegrid.llm.queries import ORACLES as LLM


def test_license_places_in_long_texts():
    (row,) = answer(LLM["op5_license_scan"], documents=("doc_id BIGINT, text VARCHAR", [(1, "w " * 30_500 + "under the MIT License")]))
    assert (row["n_base"], row["first_word"], row["base_labels"]) == (1, 30_500, "mit")


def test_windows_of_long_items():
    item = [f"w{i}" for i in range(3200)]
    (row,) = answer(LLM["op6_decontaminate"], documents=("doc_id BIGINT, text VARCHAR", [(1, " ".join(item[3100:3120]))]), benchmark=("item_id BIGINT, text VARCHAR", [(7, " ".join(item))]))
    assert (row["n_hit"], row["n_items"], row["contaminated"]) == (20, 1, True)
