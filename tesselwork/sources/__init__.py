"""Where catalogues live: the commit log and the tables of a repository."""
