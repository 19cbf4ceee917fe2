"""ionloom.operators"""
