"""Operators on DataFrames of lines: linking, planning, producing, guarding, deciding, reporting.

``lines`` has one row a line: page_id, line_id (together its key), ord (its place on the page)
and text; operators name the further columns they read. Order is data: every operator sorts by
columns, never by the order of rows."""
