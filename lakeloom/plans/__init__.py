"""Query texts and what is read from plans."""
