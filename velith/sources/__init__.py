"""Where rows come from and go to: files, registries, configuration, snapshot tables, model seams."""
