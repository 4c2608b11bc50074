"""Documents to Markdown and queryable structure, as DataFrame plans."""
