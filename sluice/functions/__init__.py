"""Column-level building blocks: hashes, list unpacking, types, tokens, ranking."""

from sluice.functions.hashing import hash_columns_for, record_hash, with_record_hash
from sluice.functions.joins import join_per_key
from sluice.functions.lists import explode_list, parse_list, split_list
from sluice.functions.ranking import sequence_within_groups
from sluice.functions.types import WIDENING, is_widening, type_name

__all__ = [
    "hash_columns_for", "record_hash", "with_record_hash", "join_per_key",
    "explode_list", "parse_list", "split_list", "sequence_within_groups", "WIDENING", "is_widening",
    "type_name",
]
