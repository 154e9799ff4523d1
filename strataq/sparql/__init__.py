"""strataq.sparql"""
