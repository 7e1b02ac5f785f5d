"""Change-log audit and reconciliation as DataFrame-to-DataFrame operators."""
