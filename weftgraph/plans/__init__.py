"""Plans: pipelines, sweeps and the catalogue of queries."""
