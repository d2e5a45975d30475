"""Where records come from and go to: URL lists, the pages table, the article collection."""
