"""strataq.operators"""
