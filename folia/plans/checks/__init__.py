"""The check-expression language: formulas over documents, compiled to Catalyst expressions."""

from .compiler import FUNCTIONS, Scope, Value, compile_check, function, rule_formula, ruleset, used_fields
from .parser import CheckError, parse

__all__ = ["FUNCTIONS", "CheckError", "Scope", "Value", "compile_check", "function", "parse", "rule_formula", "ruleset", "used_fields"]
