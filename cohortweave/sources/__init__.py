"""Spec-driven readers, the standard-table sink and the bundled test-table views."""
