"""ionloom.sources"""
