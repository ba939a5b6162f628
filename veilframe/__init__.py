"""Find and handle personal data in text columns, records and files at scale, on Spark."""

from .catalog.policies import POLICIES, Policy
from .catalog.profiles import PROFILES, Profile
from .catalog.rules import RuleBook, default_book
from .functions.pseudonym import Pseudonyms
from .functions.sqlnames import register_functions
from .operators.dictionary import term_hits, with_terms
from .operators.models import model_hits
from .operators.policy import apply_policy, apply_policy_by_column, block_rates
from .operators.preflight import preflight, preflight_gate
from .operators.records import column_profile, sanitize_json, sanitize_nested, sanitize_record, scan_record
from .operators.sanitize import batch_counts, pseudonym_map, sanitize
from .operators.scan import explain, hits_table, scan, with_hits
from .plans.config import load_config, parse_config
from .plans.flows import process_record, process_text, scan_and_sanitize

__all__ = [
    "POLICIES", "Policy", "PROFILES", "Profile", "RuleBook", "default_book", "Pseudonyms", "register_functions",
    "apply_policy", "apply_policy_by_column", "block_rates", "preflight", "preflight_gate", "column_profile",
    "sanitize_json", "sanitize_nested", "sanitize_record", "scan_record", "batch_counts", "pseudonym_map",
    "sanitize", "explain", "hits_table", "scan", "term_hits", "with_hits", "with_terms", "model_hits", "load_config", "parse_config",
    "process_record", "process_text", "scan_and_sanitize",
]
