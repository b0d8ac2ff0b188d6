"""DataFrame operators: import, resolution, reconciliation, accounting, export, reporting, boards, text."""
