"""siltbed.sources"""
