"""kinframe: DataFrame operators for photo catalogs, face vectors and clusterings."""
