"""Sources and sinks: snapshots, journals, cassettes, generators."""
