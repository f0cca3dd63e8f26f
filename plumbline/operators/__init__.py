"""DataFrame operators: curation, records, scoring, ranking, planning and serving."""
