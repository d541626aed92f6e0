"""Sources: message topics, tables and JDBC."""
