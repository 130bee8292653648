"""Registered queries: each operator bound to the shared test tables, with its SQL counterpart."""
