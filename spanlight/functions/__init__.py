"""Scalar functions: text folding, tokenizing, confirmation, costs."""
