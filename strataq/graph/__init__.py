"""strataq.graph"""
