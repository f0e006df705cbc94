"""Sources: folders, registries, crawled pages, archives."""
