"""The registered queries: each operator over the driver tables, with the SQL that checks it."""
