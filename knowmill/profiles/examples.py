"""A small file for each built-in profile, and the fact that it holds: (kind, framework, path, content, first, second).

The facts are method and path of routes and calls, role and name of queues, class and table of models.
"""

EXAMPLES = [
    ("rest", "actix", "r/a.rs", 'use actix_web::web;\nApp::new().route("/crates", web::post().to(f))\n', "POST", "/crates"),
    ("rest", "aspnet", "r/b.cs", 'using Microsoft.AspNetCore.Mvc;\n[Route("shop/[controller]")]\npublic sealed class CartController : ControllerBase {\n  [HttpPut("{key}")]\n}\n', "PUT", "shop/cart/{key}"),
    ("rest", "django", "r/urls.py", "from django.urls import path\nurlpatterns = [path('lamps/', v)]\n", "PATH", "lamps/"),
    ("rest", "echo", "r/c.go", 'import "github.com/labstack/echo/v4"\ne.GET("/cups", h)\n', "GET", "/cups"),
    ("rest", "express", "r/d.js", "const x = require('express')\nrouter.patch('/pens/:id', f)\n", "PATCH", "/pens/:id"),
    ("rest", "fastapi", "r/e.py", 'from fastapi import APIRouter\n@router.delete("/rugs/{id}")\n', "DELETE", "/rugs/{id}"),
    ("rest", "fastify", "r/f.ts", 'import Fastify from "fastify"\nfastify.get("/mats", f)\n', "GET", "/mats"),
    ("rest", "flask", "r/g.py", "from flask import Flask\n@bp.route('/jars', methods=['POST'])\n", "POST", "/jars"),
    ("rest", "gin", "r/h.go", 'import "github.com/gin-gonic/gin"\nengine.DELETE("/pans/:id", h)\n', "DELETE", "/pans/:id"),
    ("rest", "hono", "r/i.ts", "import { Hono } from 'hono'\napp.all('/any', c)\n", "ALL", "/any"),
    ("rest", "koa", "r/j.js", "const R = require('@koa/router')\nrouter.head('/pots', f)\n", "HEAD", "/pots"),
    ("rest", "laravel", "r/k.php", "use Illuminate\\Support\\Facades\\Route;\nRoute::any('/hats', 'H@x');\n", "ANY", "/hats"),
    ("rest", "phoenix", "r/l.ex", 'use Phoenix.Router\n  get "/keys", KeyController, :index\n', "GET", "/keys"),
    ("rest", "rails", "r/routes.rb", "Rails.application.routes.draw do\n  post '/bags', to: 'bags#new'\nend\n", "POST", "/bags"),
    ("rest", "rocket", "r/m.rs", '#[macro_use] extern crate rocket;\n#[options("/oils")]\nfn f() {}\n', "OPTIONS", "/oils"),
    ("rest", "slim", "r/n.php", "use Slim\\App;\n$app->get('/nets', f);\n", "GET", "/nets"),
    ("rest", "spring", "r/O.java", 'import org.springframework.web.bind.annotation.*;\n@PatchMapping(path = "/inks/{id}")\n', "PATCH", "/inks/{id}"),
    ("rest", "vapor", "r/p.swift", 'import Vapor\nroutes.put("ribs") { r in }\n', "PUT", "ribs"),
    ("client", "aiohttp", "c/a.py", "import aiohttp\nawait session.get('/cogs')\n", "GET", "/cogs"),
    ("client", "angular_httpclient", "c/b.ts", "import { HttpClient } from '@angular/common/http'\nthis.http.post<Bolt>('/bolts', b)\n", "POST", "/bolts"),
    ("client", "axios", "c/c.js", "import axios from 'axios'\nconst r = api.put(`/nuts`, n)\n", "PUT", "/nuts"),
    ("client", "dotnet_httpclient", "c/d.cs", 'using System.Net.Http;\nawait web.DeleteAsync("/gears/1");\n', "DELETE", "/gears/1"),
    ("client", "faraday", "c/e.rb", "require 'faraday'\nconn.patch('/cams')\n", "PATCH", "/cams"),
    ("client", "feign", "c/F.java", '@FeignClient(name = "mill", path = "/v2")\ninterface M {\n  @GetMapping("/rods")\n}\n', "GET", "/v2/rods"),
    ("client", "fetch", "c/g.mjs", "await fetch('/axles')\n", "GET", "/axles"),
    ("client", "go_nethttp", "c/h.go", 'import "net/http"\nreq, _ := http.NewRequest("PUT", "/belts", nil)\n', "PUT", "/belts"),
    ("client", "got", "c/i.ts", 'import got from "got"\nawait got.head("/hubs")\n', "HEAD", "/hubs"),
    ("client", "guzzle", "c/j.php", "use GuzzleHttp\\Client;\n$c->request('PATCH', '/rims');\n", "PATCH", "/rims"),
    ("client", "httparty", "c/k.rb", "require 'httparty'\nHTTParty.get('/tubes')\n", "GET", "/tubes"),
    ("client", "httpx", "c/l.py", "import httpx\nclient.options(f'/wires')\n", "OPTIONS", "/wires"),
    ("client", "jquery", "c/m.js", "import $ from 'jquery'\n$.getJSON('/plugs', f)\n", "GET", "/plugs"),
    ("client", "ky", "c/n.ts", "import ky from 'ky'\nawait ky('/fuses')\n", "GET", "/fuses"),
    ("client", "requests", "c/o.py", "import requests\nrequests.request('DELETE', '/lamps')\n", "DELETE", "/lamps"),
    ("client", "reqwest", "c/p.rs", 'use reqwest;\nself.client.post("/coils")\n', "POST", "/coils"),
    ("client", "restsharp", "c/q.cs", 'using RestSharp;\nvar r = new RestRequest("/discs", Method.Put);\n', "PUT", "/discs"),
    ("client", "resttemplate", "c/R.java", 'import org.springframework.web.client.RestTemplate;\nrestTemplate.exchange("/seals", HttpMethod.DELETE, e, X.class);\n', "DELETE", "/seals"),
    ("client", "resty", "c/s.go", 'import "github.com/go-resty/resty/v2"\nc.R().Options("/shims")\n', "OPTIONS", "/shims"),
    ("client", "vue_resource", "c/t.vue", "import VR from 'vue-resource'\nthis.$http.delete('/clips')\n", "DELETE", "/clips"),
    ("client", "webclient", "c/U.java", 'import org.springframework.web.reactive.function.client.WebClient;\nw.put()\n  .uri("/pins")\n', "PUT", "/pins"),
    ("client", "xhr", "c/v.js", "const x = new XMLHttpRequest()\nx.open('GET', '/caps')\n", "GET", "/caps"),
    ("queue", "amqplib", "q/a.js", "const a = require('amqplib')\nch.publish('ex', 'red.key', b)\n", "producer", "red.key"),
    ("queue", "bullmq", "q/b.ts", "import { Worker } from 'bullmq'\nnew Worker('mail', f)\n", "consumer", "mail"),
    ("queue", "confluent_kafka", "q/c.py", "from confluent_kafka import Consumer\nc.subscribe(['rain'])\n", "consumer", "rain"),
    ("queue", "kafkajs", "q/d.ts", "import { Kafka } from 'kafkajs'\nawait p.send({\n  acks: 1,\n  topic: 'snow' })\n", "producer", "snow"),
    ("queue", "pika", "q/e.py", "import pika\nch.basic_consume(on, queue='hail')\n", "consumer", "hail"),
    ("queue", "segmentio_kafka", "q/f.go", 'import "github.com/segmentio/kafka-go"\nr := kafka.NewReader(kafka.ReaderConfig{Topic: "wind"})\n', "consumer", "wind"),
    ("queue", "spring_amqp", "q/G.java", 'import org.springframework.amqp.rabbit.annotation.*;\n@RabbitListener(\n  queues = "fog")\n', "consumer", "fog"),
    ("queue", "spring_kafka", "q/H.java", 'import org.springframework.kafka.core.*;\nkafkaTemplate.send("mist", v);\n', "producer", "mist"),
    ("orm", "activerecord", "o/app/models/a.rb", 'class Tree < ApplicationRecord\n  self.table_name = "trees_old"\nend\n', "Tree", "trees_old"),
    ("orm", "django", "o/models.py", "class Leaf(models.Model):\n    name = models.CharField()\n    class Meta:\n        db_table = 'leafs'\n", "Leaf", "leafs"),
    ("orm", "entity_framework", "o/b.cs", '[Table("Roots")]\npublic class Root : Base { }\n// DbSet<Root>, [Column("x")]\n', "Root", "roots"),
    ("orm", "jpa", "o/C.java", '@Entity\n@Table(name = "barks")\npublic class Bark { }\n', "Bark", "barks"),
    ("orm", "prisma", "o/schema.prisma", 'model Twig {\n  id Int\n  @@map("twigs_v2")\n}\n', "Twig", "twigs_v2"),
    ("orm", "sqlalchemy", "o/d.py", "class Seed(Base):\n    __tablename__ = 'seed_bank'\n    id = Column(Integer)\n", "Seed", "seed_bank"),
    ("orm", "typeorm", "o/e.ts", "@Entity('petals')\nexport class Petal {\n  @Column()\n  name: string\n}\n", "Petal", "petals"),
]
