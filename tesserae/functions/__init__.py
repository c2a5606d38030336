"""tesserae.functions"""
