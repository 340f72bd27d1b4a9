"""siltbed.functions"""
