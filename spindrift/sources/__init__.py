"""Sources of candidates: fixture documents, paged services and their composition."""
