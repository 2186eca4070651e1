"""Sources and sinks: documents, archives, vector tables and the commit log."""
