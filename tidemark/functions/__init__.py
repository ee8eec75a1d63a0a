"""Column macros: everything here is a plain Catalyst expression."""

from .expr import clip, code_of, expit, indicator, logit, quasi_loglik, safe_logit, shrink, total, wsum

__all__ = ["clip", "code_of", "expit", "indicator", "logit", "quasi_loglik", "safe_logit", "shrink", "total", "wsum"]
