"""Sources and sinks: dictionaries, delimited files, exports."""
