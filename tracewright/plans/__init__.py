"""Settings, corpora and registered queries."""
