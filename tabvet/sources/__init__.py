"""Sources and sinks: driver tables, derived fixtures, delimited files."""
